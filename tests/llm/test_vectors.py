"""Divergence audit, nearest neighbours and vector codes: brute force, odd rows, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorelake.llm import divergence, neighbours, vector_codes
from scorelake.llm.vectors import matrix
from tests.conftest import SMALL
from tests.llm.test_llm import ODD, SCHEMA

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<float>, label int, rid long, block long, score double, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 0.5, "x") for i, v, label in rows], VECTORS)


# the audit


def brute_audit(rows, least, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        of = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-f(of[s][t], whole[t]), t) for t in kept if count[lang, s][t] and of[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def many(seed=1, n=160):
    r = random.Random(seed)
    words = ["haus", "Haus", "élan", "ÉLAN", "ein", "zwei", "x1y", "日本", "z", *(f"w{chr(97 + i)}" for i in range(26))]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(n)]
    return [(i, t, r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ä", "z", None, *(f"s{k}" for k in range(9))]), 0, 1, 0.5) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least, cut", [(1, {}), (10, {}), (3, {"stripe_counts": 5, "tile_groups": 3}), (1000, {})])
def test_audit_against_brute_force(spark, least, cut):
    rows = many() + ODD + [ODD[4]] * 3
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), least=least, **cut).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, least)


def test_audit_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "ein haus, größer als alle andereninderganzenstadt 1 x".encode()
    parts = list(divergence.slices(text))
    assert b"".join(parts) == text and len(parts) > 3
    assert [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


@pytest.mark.parametrize("shape", [(1, 1), (2, 9), (7, 40), (20, 3), (5, 0)])
def test_quadtree_prices_all_cells(shape):
    rng = np.random.default_rng(0)
    full = rng.random(shape) < 0.3
    row, column = np.nonzero(full)
    value, zero = rng.integers(1, 10**9 + 2, len(row)), rng.integers(1, 1000, shape[0])
    dense = np.repeat(zero[:, None], shape[1], 1).astype(np.int64)
    dense[row, column] = value
    got = divergence.Quadtree(row, column, value, zero, shape[1]).pairs(shape[0], 0)
    for i in range(shape[0]):
        for j in range(i + 1, shape[0]):
            assert got[i, j] == sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(dense[i], dense[j]))


# neighbours


def brute_neighbours(rows, k=20, every=20):
    good = [(n, i, [float(np.float32(x)) for x in v]) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, i, v in good:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j) for m, j, w in good if m != n)
            out[n] = (i, [(j, -s) for s, j in found[:k]])
    return out


def rows_of(got):
    return sorted((r.query_id, r.rank, math.inf if r.vec_id is None else r.vec_id, r.score) for r in got)


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 2.0], 1), (20, [1.0, 0.0, 2.0], 1), (3, [1.0, 0.0, 2.0], 1), (3, [1.0, 0.0, 2.0], 1), (4, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, None, 1.0], 2)]
    rows += [(80, [NAN, 0.0, 1.0], 1), (100, [INF, 1.0, 1.0], 1), (None, [5.0, 5.0, 5.0], None), (120, [3.0], None), (140, [], 1), (7, [-1.0, 4.0, 0.5, 9.0], None), (20, [0.5, 0.5, 0.5], 3)]
    want = sorted((i, rank, j, s) for i, found in brute_neighbours(rows, 5).values() for rank, (j, s) in enumerate(found, 1))
    assert rows_of(neighbours.nearest(vectors(spark, rows), k=5).collect()) == want
    assert {r.query_id for r in neighbours.nearest(vectors(spark, rows)).collect()} == {0, 20, 120}
    assert neighbours.nearest(vectors(spark, [])).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1.0], 1)])).collect() == []


@pytest.mark.parametrize("lengths", ["one", "many"])
def test_recall_over_many_blocks(spark, lengths):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, 4000)] + 0.3 * rng.standard_normal((4000, 24))
    x[1000:2300] = x[1000]  # a third are copies
    x = x / np.linalg.norm(x, axis=1)[:, None] if lengths == "one" else x * rng.exponential(1, 4000)[:, None]
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    got = neighbours.nearest(vectors(spark, rows), block_rows=200, sample=1000, together=40).collect()
    x = x.astype(np.float32).astype(float)
    hits = total = 0
    by_query = defaultdict(list)
    for r in got:
        by_query[r.query_id].append(r)
    for q in range(0, 4000, 20):
        scores = neighbours.product(np.repeat(x[q : q + 1], 4000, 0), x)
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:20]
        found = sorted(by_query[q], key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.score == scores[r.vec_id] for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits, total = hits + len({r.vec_id for r in found} & set(order)), total + 20
    assert hits >= 0.95 * total


def test_copies_are_dealt_to_blocks_and_leaves_prune():
    space = neighbours.Space(8, 1.0)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = neighbours.Block(space, x, np.arange(3000), np.arange(3000))
    assert sorted(block.order) == list(range(3000)) and (block.ends - block.starts).max() <= neighbours.LEAF
    asked = []
    block.scaled = type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: asked.append(k.stop - k.start) or np.asarray(s)[k]})(block.scaled.shape, block.scaled.dtype, block.scaled)
    i, j, score = block.search(x[:1], np.array([0]), np.full(1, -np.inf), 3)
    assert sum(asked) < 3000 and len(j) == 3


def test_chi_square_values():
    assert abs(neighbours.chi_square(0.95, 8) - 15.5073) < 1e-3 and abs(neighbours.chi_square(0.5, 2) - 1.3863) < 1e-3


# codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // parts
    cut = [[v[k * w : (k + 1) * w] for _, v, _ in kept] for k in range(parts)]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0))[:entries]
    books = [[part[n] for n in first] for part in cut]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(cut, books):
            of = defaultdict(list)
            for x in part:
                of[near(x, book)[1]].append(x)
            for k, xs in of.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], Counter()
    for n, (i, _, label) in enumerate(kept):
        found = [near(part[n], book) for part, book in zip(cut, books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((repr(i), code, error, by_label[label]) for i, code, error, label in out), digest


def codes_of(spark, rows, **how):
    codes, books = vector_codes.vector_codes(vectors(spark, rows), **how)
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in codes.collect()), vector_codes.digest(books)


def test_codes_of_odd_rows(spark):
    rows = [(5, [1.0, -0.5, 0.25, 0.1], 1), (5, [1.0, -0.5, 0.25, 0.1], 1), (None, [2.0, 2.0, 2.0, 2.0], None), (1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [NAN] * 4, 1), (4, [INF] * 4, 1)]
    rows += [(9, [0.0] * 4, None), (8, [3.0], 2), (7, [], 2), (6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 2), (10, [3e30, 1.0, -3e30, 0.0], 3)]
    assert codes_of(spark, rows[:-1]) == brute_codes(rows[:-1])
    assert codes_of(spark, rows[:-1], entries=3) == brute_codes(rows[:-1], entries=3)
    codes, _ = codes_of(spark, rows, entries=3)  # whole numbers beyond 64 bits
    want, _ = brute_codes(rows, entries=3)
    assert [r[1] for r in codes] == [r[1] for r in want]
    assert codes_of(spark, []) == ([], hashlib.sha256(b"").hexdigest())


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 12)).astype(np.float32)
    x[100:260] = x[7]
    rows = [(int(i) // 2 * 3, [float(c) for c in v], int(i) % 3 or None) for i, v in enumerate(x)]
    rows = [(i, v, label) for k, (i, v, label) in enumerate(rows) if k % 2 == 0]
    assert codes_of(spark, rows, entries=40) == brute_codes(rows, entries=40)


def test_cold_labels_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 4)
    rows = [(i, [float(i % 5), 1.0, 2.0, float(i)], None if i % 2 else i) for i in range(30)]
    assert codes_of(spark, rows, entries=4) == brute_codes(rows, entries=4)


@pytest.mark.parametrize("spread", [3, 2000])
def test_orchard_finds_the_nearest_and_of_equals_the_lowest(spread):
    rng = np.random.default_rng(spread)
    book, x = rng.integers(-spread, spread, (256, 3)), rng.integers(-spread, spread, (2000, 3))
    book[200:] = book[:56]
    code, distance = vector_codes.Orchard(book).nearest(x, rng.integers(0, 256, len(x)))
    apart = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (code == apart.argmin(1)).all() and (distance == apart.min(1)).all()


def test_matrix_fills_up():
    import pyarrow as pa

    assert matrix(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float32())), 2).tolist() == [[1.0, 2.0], [0.0, 0.0], [3.0, 0.0]]


def test_small_table_has_exact_neighbours(spark, duck):
    from scorelake.llm.queries import QUERIES

    got = QUERIES["op12_nearest_neighbours"](spark, SMALL).collect()
    rows = [(i, v, 0) for i, v in duck.sql("select vec_id, embedding from embeddings").fetchall()]
    want = {(i, j) for i, found in brute_neighbours(rows).values() for j, _ in found}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want) and len(got) == len(want)


# packing: ids of any text


def test_ids_are_the_tokenizers_for_any_text():
    from scorelake.llm import packing
    from scorelake.llm.queries import tokenizer_path

    tokens = packing.Tokens(tokenizer_path())
    assert tokens.known
    r = random.Random(1)
    letters = "aAbBİıßẞÉéΣσςǅﬁ日本ก1²½'’.,;:!?<|>_- \n\t ́̈̇ÅŉǰK" + "".join(map(chr, range(0x370, 0x3FF))) + "".join(map(chr, range(0x1E00, 0x1EFF)))
    texts = ["ALİ.", "VELİ, geldi", "a<|endoftext|>b", ""] + ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert list(np.frombuffer(tokens.of(t.encode()), "<u4")) == tokens.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_tokenizer_with_other_rules_gets_whole_texts(tmp_path):
    import json

    from scorelake.llm import packing
    from scorelake.llm.queries import tokenizer_path

    file = json.load(open(tokenizer_path()))
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(file))
    tokens = packing.Tokens(str(tmp_path / "other.json"))
    assert not tokens.known and len(tokens) == 0
    assert list(np.frombuffer(tokens.of(b"one  two, \n Three"), "<u4")) == tokens.tokenizer.encode("one  two, \n Three", add_special_tokens=False).ids
