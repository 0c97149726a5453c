"""Odd rows, brute force and planted cases for the training-data operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import exact_dedup, fingerprint, language_id, language_model, mixing, near_dup, packing, pii, quality, toxicity
from scorelake.llm.queries import QUERIES, SQL, tokenizer_path
from tests.conftest import SMALL, TABLES, as_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, score double"
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0, 7, 0.5), (2, "", "en", "a", 0, 7, 0.5), (3, "   \n\t ", None, "a", 4, 7, 0.5), (4, "1234 !?", "en", None, 7, 7, 0.5),
    (5, "One two three", "en", "b", 13, 7, 0.5), (5, "One two three", "en", "b", 13, 7, 0.5), (6, "ONE two three", "en", "b", 13, 7, 0.5),
    (7, LONG, "de", "b", len(LONG), 7, 0.5), (8, LONG + " ende", "de", "b", len(LONG) + 5, 7, 0.5), (None, "ohne Nummer", "de", None, None, None, None),
    (9, "Éa" * 5000, "fr", "c", 10_000, 7, 0.5), (10, "ÉA one", "fr", "c", 6, 7, 0.5), (11, "éa one", "fr", "c", 6, 7, 0.5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_give_what_sql_gives(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL), duck.sql(SQL[name])
    assert as_rows(got.columns, got.collect()) == as_rows(want.columns, want.fetchall())


def test_exact_copies(odd, none):
    rows = exact_dedup.exact_dedup(odd, head=4).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len({(r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in rows})
    assert {(r.keep_id, r.group_size) for r in rows if (r.text or "").lower() == "one two three"} == {(6, 3)}
    assert {r.doc_id for r in rows if r.kept} >= {2, 6, 10, 11, None}
    assert sorted(map(str, rows)) == sorted(map(str, exact_dedup.exact_dedup(odd, head=4, broadcast_pairs=0).collect()))
    assert exact_dedup.exact_dedup(none).count() == 0


def test_repeated_rows_keep_one(spark):
    rows = spark.createDataFrame([(4, "x y")] * 5 + [(3, "x Y")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {6}


def brute_components(texts, n=5, percent=80):
    def of(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: of(t) for i, t in texts}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("options", [{}, {"common": 2}, {"common": 2, "list_rows": 3, "kept": 50, "broadcast_ids": 0}])
def test_near_copies(spark, options):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + [word() for _ in range(40)]))
    rows = list(enumerate(texts + [None, "", texts[0].upper(), texts[4]]))
    got = near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_copies_in_portions_of_a_list(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 40  # copies make the shingles' numbers large and lists short
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:60] + [f"y{rng.random()}" for _ in range(9)]) for _ in range(8)]
    rows = list(enumerate(texts))
    for options in ({"list_rows": 3}, {"common": 2, "list_rows": 3}, {"common": 2, "list_rows": 3, "kept": 10**6, "percent": 60}):
        got = near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
        assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent=options.get("percent", 80)), options


def test_near_copies_of_groups_in_long_lists(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(250):  # sets of nine words of one small vocabulary each: many share prefix and size but not the rest
        some = []
        for _ in range(14):
            words = rng.sample(range(14), 9)
            some.append((len(rows), " ".join(f"v{k}w{w}" for w in sorted(words))))
            rows.append(some[-1])
        want |= brute_components(some, n=1)
    got = near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), n=1, common=2).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_copies_of_odd_rows(odd, none):
    got = {r.id: r.component_id for r in near_dup.near_components(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}
    assert near_dup.near_components(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i < 100 else 100 for i in [*range(41), *range(100, 130)]}


def test_subset_sums_are_exact_where_they_can_be():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.choice(np.arange(0, 40), rng.integers(1, 8), replace=False)
        stock = rng.integers(1, 4, len(lengths))
        reach = {0}
        for n, k in zip(lengths, stock):
            reach = {r + n * j for r in reach for j in range(k + 1)}
        budget = int(rng.integers(0, 1 + (lengths * stock).sum()))
        take = mixing.subset(lengths, stock, budget)
        assert (take <= stock).all() and (take >= 0).all() and (take * lengths).sum() <= budget
        assert mixing.subset(lengths, stock, int((lengths * stock).sum())).tolist() == stock.tolist()
    assert (mixing.subset(np.array([7, 5, 3]), np.array([100, 100, 100]), 701, 50) * np.array([7, 5, 3])).sum() == 701


def test_mix(spark, odd, none):
    rows = mixing.mixed(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.times
        target[r.source] = r.target
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    want, free = {}, set(size)
    while True:
        left = 1.5 * sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            free.discard(s)
    want |= share
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    for s in size:  # a few documents each: the best sum of all subsets
        rest, sums = round(want[s]) % size[s] if want[s] < 2 * size[s] else 0, {0}
        for r in rows:
            sums |= {x + r.size for x in sums} if r.source == s else set()
        assert taken[s] == round(want[s]) - rest + max(x for x in sums if x <= rest)
    again = mixing.mixed(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), broadcast_pairs=0)
    assert sorted((r.doc_id, r.times) for r in again.collect()) == sorted((r.doc_id, r.times) for r in rows)
    assert len(mixing.mixed(odd).collect()) == len(ODD) and mixing.mixed(none).count() == 0
    assert mixing.repeated(mixing.mixed(odd)).columns == odd.columns


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, "text")).distinct()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.packed(docs, tokenizer_path()).collect()
    import zlib

    held, sequences = {}, {}
    for p in pieces:
        held.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert held.keys() == texts.keys()
    for k, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(held[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.packed(none, tokenizer_path()).count() == 0 and packing.packed(odd, tokenizer_path()).count() > len(ODD)


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    import hashlib

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    assert len({t for _, t in rows}) == len({r.fingerprint for r in got.values()})
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    assert len(fingerprint.fingerprints(odd).collect()) == len(ODD) and fingerprint.fingerprints(none).count() == 0


def test_fingerprints_add_up(spark):
    texts = [("a b c\nd e f", "d e f\na b c", "a b c", "d e f")]
    df = spark.createDataFrame(texts, "x string, y string, p string, q string")
    for c in "xypq":
        df = fingerprint.vectors(df, c, f"v{c}")
    v = {c: F.col(f"v{c}") for c in "xypq"}
    same = df.select(v["x"] == v["y"], fingerprint.combined(v["p"], v["q"]) == v["x"], fingerprint.combined(v["x"], v["p"], -1) == v["q"], fingerprint.likeness(v["x"], v["y"]) == 1.0)
    assert list(same.first()) == [True] * 4


def test_personal_data(spark, odd, none):
    text = "Mail a.b@c.de, x@y or 10.0.0.255 10.0.0.256 c 4111 1111 1111 1111 é +1 (555) 123-4567 x " + "7" * 20_000
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("*", pii.spans_text(F.col("base")).alias("b")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.b == "email:5:13,ip:22:32,card:46:65,phone:68:85"
    told = [(i, f"please ring me on +1 555 000 {1000 + i} today") for i in range(30)] + [(99, "please ring me on 555-000-4444, thanks")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert got[99].n_found == 1 and got[99].n_phone == 0 and sum(r.n_found for r in got.values()) == 1
    assert len(pii.personal_data(odd).collect()) == len(ODD) and pii.personal_data(none).count() == 0


def test_personal_data_of_several_words(spark):
    told = [(i, f"please ring me on +1 555 000 {1000 + i} today, or open host at 10.0.0.{i} now") for i in range(30)]
    new = ["ring me on 555 000 4444 please", "ring me on (555) 123-4567, thanks", "ring me on 555.123.4567", "ring me on 555 000-4444 (home)", "host at fe80::1 now",
           "ring me on 5550004444 2 times", "ring me on 5550004444 5550005555", "sold 555 000 4444 units", "ring me on 12 days"]
    rows = spark.createDataFrame(told + [(100 + i, t) for i, t in enumerate(new)], "doc_id long, text string")
    found = {r.doc_id: sorted(new[r.doc_id - 100][s.start : s.end] for s in r.spans) for r in pii.personal_data(rows).where("doc_id >= 100").collect()}
    assert [found[100 + i] for i in range(len(new))] == [["555 000 4444"], ["(555) 123-4567"], ["555.123.4567"], ["555 000-4444"], ["fe80::1"], ["5550004444"], ["5550004444"], [], []]


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fitted(docs.where("doc_id % 3 <> 1"))
    held = language_id.identified(docs.where("doc_id % 3 = 1"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    got = {r.doc_id: r.lang_pred for r in language_id.identified(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5] != "und"
    assert {r.lang_pred for r in language_id.identified(odd, language_id.fitted(none)).collect()} == {"und"}
    code = language_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 10


def test_language_model(spark, odd, none):
    words = [["a b a c", "b a", "a"], ["c c a b b", "a b c d"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words[0] * 3 + words[1])], "doc_id long, text string")
    model = language_model.trained(docs)
    ids, n = language_model.word_ids([b"a b c d", b"zzz"])
    every = np.append(np.unique(ids), [np.uint64(12345)])
    kinds = np.unique(language_model.word_ids([b"a b c d"])[0])
    logs, _ = model.log_probabilities(np.append(kinds, [np.uint64(99)]), np.full(len(kinds) + 1, kinds[2]))
    assert abs((10**logs).sum() - 1) < 1e-9 and len(every)
    r = language_model.scored(odd, model).collect()
    assert len(r) == len(ODD) and all(x.score < 0 and x.train_tokens == model.tokens for x in r)
    assert language_model.scored(odd, language_model.trained(none)).where("score = 0").count() == len(ODD)
    assert language_model.scored(none, model).count() == 0


def test_quality_and_toxicity(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    for name, label, least in (("op8_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)):
        got = QUERIES[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
        assert np.mean([r["predicted"] == r[label] for r in got]) >= least
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for part in (quality, toxicity):
        for known in (labels, labels.limit(0)):
            got = part.scored(odd, part.fitted(odd, known)).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert part.scored(none, part.fitted(none, labels)).count() == 0


def test_toxicity_keeps_every_word_that_tells(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    plain, common, rare = ([word() for _ in range(k)] for k in (300, 100, 40))
    some = lambda of, k: " ".join(rng.sample(of, k))
    rows = [(i, some(plain, 30), 0) for i in range(800)]  # rare: the words of a language with few documents
    rows += [(i, some(plain, 20) + " " + (some(common, 40) if i % 4 else some(rare, 12)), 1) for i in range(800, 1600)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4).cache()
    new = spark.createDataFrame([(1, some(plain, 20) + " " + some(rare, 12)), (2, some(plain, 30)), (3, some(common, 40))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.scored(new, toxicity.fitted(docs, labels)).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(400, 3)), np.ones((400, 1))]).astype(np.float32)
    first = (x[:, 0] > 0).astype(int)
    chain = toxicity.fit_chain(x, np.stack([first, first * (x[:, 1] > 0)], 1), np.arange(400) % 5)
    p = toxicity.apply_chain(x, chain)
    assert [len(w) for w in chain] == [4, 5] and ((p[:, 0] > 0.5) == first).mean() > 0.97 and chain[1][4] > 0


def test_pipeline(spark, odd, none, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(docs.columns), SMALL).count() == 0
        kept = stage(spark, kept, SMALL)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or kept.columns == docs.columns
        rows[name] = kept
    assert rows["language_id"].count() == docs.count()
    exact = {r.doc_id: r.text for r in rows["exact_dedup"].collect()}
    assert len(exact) == len({t.lower() for t in exact.values()})
    near = {r.doc_id for r in rows["ngram_jaccard"].collect()}
    assert near == {i for i, (_, c) in brute_components(list(exact.items())).items() if i == c}
    taken = {r.doc_id: r["count"] for r in rows["mixing"].groupBy("doc_id").count().collect()}
    assert taken.keys() <= near and set(taken.values()) <= {1, 2}
    assert corpus_pipeline.run(spark, SMALL).count() == rows["packing"].count()


def test_what_a_worker_of_the_pipeline_holds(spark, odd):
    """Texts go to the classifier once, and the packing stage leaves no ids behind."""
    from scorelake.llm.queries import tokenizer_path

    model = language_id.fitted(odd)
    plan = language_id.identified(odd, model)._jdf.queryExecution().executedPlan().toString()
    assert "__text" not in plan
    packing.tokens(tokenizer_path(), 1000)
    assert packing.KEPT
    packing.tokens(tokenizer_path(), 1000, keep=False).of(b"one two")
    assert not packing.KEPT
