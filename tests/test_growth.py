"""Work that must not grow with copies of what is already worked out."""

import pyarrow as pa
from pyspark.sql import functions as F

from scorelake.operators import timing

EVIDENCE = {
    "stem": "boolean", "beams": "bigint", "beam_conf": "double", "dot": "boolean", "tuplet": "bigint",
    "circled": "boolean", "rest_kind": "string", "short_stem": "boolean", "spacing_guess": "bigint",
}


def test_readings_of_usual_evidence_come_from_the_table_and_equal_those_worked_out(spark):
    rows = [
        (stem, beams, conf, dot, tuplet, circled, rest, short, guess)
        for stem in (True, False, None) for beams in (0, 2, 5, None) for conf in (0.2, 0.7) for dot in (True, False)
        for tuplet in (None, 3, 4) for circled in (True, False) for rest in (None, "rest_block", "rest_16", "rest_2")
        for short in (True, False) for guess in (None, 3, 32)
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in EVIDENCE.items()))
    got = timing.with_readings(df, "got", **{k: k for k in EVIDENCE})
    both = timing._worked_out(got, "want", timing._readings(**{k: F.col(k) for k in EVIDENCE}))
    assert both.count() == len(rows)
    assert both.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    # beats that the table covers are not worked out in their row
    known = got.where("rest_kind = 'rest_16' or rest_kind is null and stem and beams = 2 and tuplet = 3").select(*EVIDENCE)
    code = timing._evidence_code(**{k: F.col(k) for k in EVIDENCE})
    assert known.where(code.isNull()).count() == 0


def test_equal_measures_are_solved_once(monkeypatch):
    calls = []
    plain = timing.best_places
    monkeypatch.setattr(timing, "best_places", lambda *a: calls.append(a) or plain(*a))
    half = {"duration": 2, "dots": 0, "tuplet": None, "p": 0.9}
    quarter = {"duration": 4, "dots": 0, "tuplet": None, "p": 0.4}
    measures = [[[quarter, half], [half]], [[quarter] * 1, [half]], [[quarter, half], [half]]] * 500
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("options", pa.list_(pa.struct([
        ("duration", pa.int64()), ("dots", pa.int64()), ("tuplet", pa.int64()), ("p", pa.float64())])))]))
    beats = [[{"pos": i, "options": o} for i, o in enumerate(m)] for m in measures]
    n = len(beats)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(beats, kind), pa.array([timing.tk.TICKS] * n), pa.array([True] * n)], names=["_beats", "room", "_triplets"]
    )
    solver = timing.Solver()
    for part in (batch.slice(0, 700), batch.slice(700)):  # slices, as their offsets don't begin at 0
        _, made = solver.solve(part, "options", "room")
        at = 0
        for m in part.column("_beats").to_pylist():
            chosen, ok, score = timing.best_exact_sum([b["options"] for b in m], timing.tk.TICKS)
            here = slice(at, at + len(m))
            assert list(made["duration"][here]) == [o["duration"] for o in chosen]
            assert set(made["ok"][here]) == {ok} and set(made["score"][here]) == {score}
            at += len(m)
    in_solver = [c for c in calls if len(c) == 3 and isinstance(c[1], int) and c[2] is True]
    assert len(in_solver) - n == 2


def test_nearest_fraction_rounds_half_to_even(spark):
    got = spark.range(0, 400).select((F.col("id") / 97).alias("v")).select("v", timing.nearest_fraction(F.col("v"), 64).alias("f")).collect()
    for v, f in got:
        assert (f["e"], f["q"], f["p"]) == min((abs(v - round(v * q) / q), q, round(v * q)) for q in range(1, 65))


def test_the_step_of_an_onset_is_a_divisor_of_the_whole_note(spark):
    import math

    from scorelake.operators.voices import _step

    onsets = [0, 1, 5, 7, 12, 5040, 10080, 40320, 80640, 161280, 80639, 315]
    rows = spark.createDataFrame([(o,) for o in onsets], "o bigint").select("o", _step(F.col("o")).alias("s")).collect()
    assert all(r.s == math.gcd(r.o, timing.tk.TICKS) for r in rows)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_fold_the_voices_once(spark):
    import __spark_entry__ as entry
    from conftest import SMALL

    plan = _plan(entry.queries()["win12_gap_rows"](spark, SMALL))
    assert sum("aggregate(" in line for line in plan.splitlines()) == 1


def test_videos_are_counted_many_to_a_batch(spark):
    from scorelake.operators import intervals

    rows = [(v, f, a, a + 3) for v in range(40) for f in range(5) for a in (f, 10 + v % 3, 30)]
    df = spark.createDataFrame(rows, "v long, f long, a long, b long")
    got = intervals.support(df, ["v"], "f", "a", "b")
    assert "FlatMapGroups" not in _plan(got)
    want = {
        (v, a, b): len({f for w, f, x, y in rows if w == v and x <= b and a <= y}) for v, _, a, b in rows
    }
    assert {(r.v, r.a, r.b): r.frames for r in got.collect()} == want


def test_cut_rows_are_dealt_by_their_number(spark, monkeypatch):
    from scorelake.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 8)
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 16)
    rows = spark.range(4000).selectExpr("id % 500 k", "id")
    got = ordered.scan(rows, "k", ["id", "id"], {"n": ordered.row_number()}, keep=True)
    tasks = got.schema[ordered.CHUNK].metadata["tasks"]
    assert 100 < tasks < 500 and got.rdd.getNumPartitions() == tasks  # 250, give or take what marks tell
    assert ordered.chunked(got, ["k"], ["id"]) is got  # an order column that is named twice counts once
    assert {(r.k, r.id, r.n) for r in got.collect()} == {(i % 500, i, i // 500 + 1) for i in range(4000)}


def test_placed_items_are_worked_out_once(spark):
    from scorelake.operators import packing

    df = spark.range(50).selectExpr("id % 5 k", "id", "id % 7 size")
    plan = _plan(packing.packed_pages(df, ["k"], "id", "size", 20, 1))
    assert "Range" not in plan and "LogicalRDD" in plan


def test_exact_groups_read_rows_once(spark):
    from scorelake.operators import reports

    rows = [(1, "a", "a"), (1, "b", "b"), (2, "a", "b"), (2, "b", "a"), (3, "a", None), (4, "a", "b"), (5, None, None)]
    df = spark.createDataFrame(rows, "p long, x string, y string")
    side = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("x")))
    got = reports.exact_groups(df, ["p"], ["x"], side("x"), side("y"))
    assert {(r.p, r.e) for r in got.collect()} == {(1, True), (2, True), (3, False), (4, False)}
    import __spark_entry__ as entry
    from conftest import SMALL

    assert "Join" not in _plan(entry.queries()["ev11_exact_measures"](spark, SMALL))


def test_periods_of_screens_are_worked_out_once(spark):
    import __spark_entry__ as entry
    from conftest import SMALL

    assert "l_orderkey" not in _plan(entry.queries()["seq23_screen_measures"](spark, SMALL))


def test_pieces_of_one_shape_are_aligned_together():
    import random

    from scorelake.operators import alignment as al

    dice = random.Random(5)
    measure = lambda: [dice.choice("abcd") for _ in range(dice.randint(0, 4))]
    pieces = [([measure() for _ in range(dice.randint(1, 4))], [measure() for _ in range(dice.randint(1, 4))]) for _ in range(300)]
    kind = pa.list_(pa.list_(pa.string()))
    gs, ps = (pa.array([x[k] for x in pieces], kind) for k in (0, 1))
    got = {}
    steps = 0
    for at, g, r in al.solve_many(gs.slice(7), ps.slice(7)):  # slices, as their offsets don't begin at 0
        steps += 1
        for k, x, y in zip(at.tolist(), g.tolist(), r.tolist(), strict=True):
            got.setdefault(k + 7, []).append((None if x < 0 else x, None if y < 0 else y))
    for k, (a, b) in enumerate(pieces[7:], 7):
        _, moves = al.solve_block(a, b, al._gaps(0, len(b)), al._gaps(0, len(a)))
        out, i, j = al.walk_back(moves, len(a), len(b))
        assert got[k] == out + [(x, None) for x in range(i - 1, -1, -1)] + [(None, x) for x in range(j - 1, -1, -1)]
    assert steps <= 16 * 8  # not one for each piece


def test_measures_are_parsed_once(spark):
    from scorelake.sources import documents

    df = spark.createDataFrame([(1, '<measure number="1"/>'), (2, "<measure")], "k long, x string")
    for got in (documents.parse_measures(df, "x"), documents.measures_in_force(df, "k", ["k"], "x")):
        assert _plan(got).lower().count("from_xml(") + _plan(got).lower().count("xmltostructs(") == 1
        assert [r.number for r in got.collect()] == [1]


ODD_PARTS = (
    "", "<MasterBars/>", "<MasterBars>text</MasterBars>", "<MasterBars><Other>1</Other></MasterBars>", "<MasterBars><MasterBar/></MasterBars><Notes>&bad;</Notes>",
    "<MasterBars><MasterBar/></MasterBars><Notes><Note>", "<MasterBars><MasterBar/></MasterBars><Notes><Note><Tie>abc</Tie></Note></Notes>",
)


def test_heads_of_tracks_are_read_in_one_pass_without_the_id_tables(spark):
    from scorelake.sources import linked

    track = lambda n: f'<Tracks><Track><Name>{n}</Name><Properties><Property name="Tuning"><Pitches>40 45</Pitches></Property></Properties></Track></Tracks>'
    texts = [None, "x", "<GPIF><Tracks><Track><Name>Solo</Name></Track><Track/></Tracks><MasterBars/></GPIF>", *(f"<GPIF>{track(n)}{x}</GPIF>" for n in ("Lead", "Solo") for x in ODD_PARTS)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    got = linked.heads(df, ["id"], "x", "Lead")
    plan = _plan(got)
    assert plan.lower().count("from_xml(") + plan.lower().count("xmltostructs(") == 1 and "Rhythm" not in plan
    docs = linked.parsed(df, "x")
    want = [(r.id, r.tuning, r.strings, r.tempo, None) for r in linked.tracks(docs, ["id"], "Lead").collect()]
    want += [(r.id, None, None, None, r.reason) for r in linked.without_track(docs, ["id"], "Lead").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_notes_of_a_piece_are_grouped_once_while_short(spark):
    from conftest import SMALL

    from scorelake.plans import inputs

    for made in (inputs.linked_documents, inputs.song_documents):
        assert sum(line.lstrip(" :+-").startswith("Aggregate [") and "collect_list" in line for line in _plan(made(spark, SMALL)).splitlines()) == 1


def test_keys_that_were_not_cut_are_repaired_in_one_pass(spark, monkeypatch):
    import random

    from scorelake.operators import ordered, repair

    dice = random.Random(3)
    rows = [(k, i, dice.choice([None, i + 5, i + 5, i + 9, i - 2]), dice.random()) for k in range(30) for i in range(40 if k % 3 else 2)]
    df = spark.createDataFrame(rows, "k long, i long, n long, conf double")
    want = sorted(map(tuple, repair.repaired_numbers(df, ["k"], "i", "n", "conf").collect()))
    assert want[0][:2] == (0, 0) and len(want) == len(rows)
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 9)
    got = repair.repaired_numbers(df, ["k"], "i", "n", "conf")
    assert sorted(map(tuple, got.collect())) == want
    for made in (ordered.apart(df, "k", "i")):  # the cut is used again, also on the way back
        assert ordered.chunked(made, "k", "i") is made
    turned = ordered.backwards(ordered.chunked(df, "k", "i").where("_chunk >= 0").selectExpr("k", "i", "_chunk", "-i r"), "k", "r")
    assert ordered.chunked(turned, "k", "r") is turned
    assert turned.groupBy("k").agg(F.max_by("_last", "r").alias("l"), F.max("_chunk").alias("m"), F.max_by("_chunk", "r").alias("n")).where("not l or m <> n").count() == 0
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 1 << 20)
    plain = repair.repaired_numbers(df, ["k"], "i", "n", "conf")
    assert sum("MapInPandas" in line for line in _plan(plain).splitlines()) == 1


def test_kinds_of_objects_and_lists_are_told_without_a_look_inside(spark):
    from scorelake.sources import checks

    texts = ['{}', '{"a": 1}', '{"_": [1]}', '{"_": {"_": null}}', "[]", "[1]", '[{}, 1, null, "a", [2]]', "null", "1", "1.5", "1e300", "true", '"a"', '"{}"', '""', None]
    df = spark.createDataFrame([(x,) for x in texts], "x string").withColumn("v", F.parse_json("x"))
    kinds = ("OBJECT", "ARRAY", "BIGINT", "STRING", "VOID", "BOOLEAN")
    plain = lambda k: F.coalesce(F.startswith(checks.kind_of(F.col("v")), F.lit(k)), F.lit(False))
    rows = df.select("x", *(checks.is_kind(F.col("v"), k).alias(f"is_{k}") for k in kinds), *(plain(k).alias(f"was_{k}") for k in kinds)).collect()
    assert all(r[f"is_{k}"] == r[f"was_{k}"] for r in rows for k in kinds)
    assert "schema_of_variant" not in _plan(df.select(checks.is_kind(F.col("v"), "OBJECT", "ARRAY"))).lower().replace("schemaofvariant", "schema_of_variant")


def test_sightings_keep_their_cut_and_medians_their_counts(spark, tiny_chunks):
    from conftest import SMALL

    from scorelake.operators import ordered
    from scorelake.plans import folds

    seen = folds.sightings(spark, SMALL)
    assert ordered.CHUNK in seen.columns and ordered.chunked(seen, ["piece"], ["pos"]) is seen
    df = spark.range(60).selectExpr("id % 3 k", "cast(id % 7 as double) v")
    got = ordered.median(df, ["k"], "v", "m")
    assert "Range" not in _plan(got) and {r.k: r.m for r in got.collect()} == {k: sorted(float(i % 7) for i in range(60) if i % 3 == k)[9:11][0] / 2 + sorted(float(i % 7) for i in range(60) if i % 3 == k)[9:11][1] / 2 for k in range(3)}


def _exchanges(df):
    """Shuffles of rows in the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_of_a_video_meet_once_and_long_videos_give_the_same_regions(spark, monkeypatch):
    import random

    import __spark_entry__ as entry
    from conftest import SMALL
    from scorelake.operators import ordered, regions

    assert _exchanges(entry.queries()["agg1_region_consensus"](spark, SMALL)) <= 1
    rng = random.Random(4)
    odd = lambda v: None if rng.random() < 0.03 else v
    rows = [
        (odd(v), odd(f), odd(top), odd(top + rng.randint(0, 30)), odd(rng.randint(1, 4)), odd(rng.randint(0, 50)), odd(rng.randint(300, 350)), odd(rng.randint(1, 3)), i)
        for v in range(40) for f in range(rng.randint(1, 9)) for top in rng.sample(range(120), rng.randint(1, 6)) for i in range(rng.randint(1, 3))
    ]
    rows += [(99, 5, 10, 20, 2, None, 310, None, 0), (98, 1, None, None, 2, 1, 310, 1, 0)]
    df = spark.createDataFrame(rows, "vid long, frame long, top long, bottom long, lines long, x0 long, x1 long, s long, rid long").cache()
    for frames in (None, df.select("vid", "frame").union(spark.createDataFrame([(1, 70), (1, 71), (97, 1)], "vid long, frame long"))):
        made = []
        for rows_per_chunk in (1 << 20, 1):  # with 1 each row is a mark, so that all videos are long
            monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", rows_per_chunk)
            made.append({r.vid: tuple(r) for r in regions.region_consensus(df, frames, "vid", "frame", 360, 450, 64, order=["rid"]).collect()})
        assert made[0] == made[1] and len(made[0]) == (43 if frames is None else 44)
        assert made[0][99][1:] == (0, 0, 360, 450, 1.0) and made[0][98][1:] == (0, 300, 360, 150, 0.0) and made[0][None][-1] == 0


def _cut_or_not(spark, monkeypatch, query):
    """Rows of a query, and the same with pieces that are cut for the most part."""
    import __spark_entry__ as entry
    from conftest import SMALL
    from scorelake.operators import ordered

    made = []
    for rows_per_chunk in (1 << 20, 16):
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", rows_per_chunk)
        df = entry.queries()[query](spark, SMALL)
        made.append(sorted(repr(tuple(r)) for r in df.collect()))
    return made


def test_two_voices_of_a_measure_are_solved_where_their_piece_is(spark, monkeypatch):
    import __spark_entry__ as entry
    from conftest import SMALL

    assert _exchanges(entry.queries()["udf5_two_voice_timing"](spark, SMALL)) <= 2  # by piece, and behind the solver
    whole, cut = _cut_or_not(spark, monkeypatch, "udf5_two_voice_timing")
    assert len(whole) > 5000 and whole == cut


def test_notation_is_written_where_a_piece_is(spark, monkeypatch):
    import __spark_entry__ as entry
    from conftest import SMALL

    assert _exchanges(entry.queries()["snk2_notation_rows"](spark, SMALL)) <= 2  # by piece, and the small table of symbols
    whole, cut = _cut_or_not(spark, monkeypatch, "snk2_notation_rows")
    assert len(whole) > 1500 and whole == cut


def test_beats_and_edits_meet_once(spark, monkeypatch):
    import random

    import __spark_entry__ as entry
    from conftest import SMALL
    from scorelake.operators import edits, ordered

    assert _exchanges(entry.queries()["ed6_insert_and_delete"](spark, SMALL)) <= 2  # by piece, and with the edits by measure
    rng = random.Random(7)
    beats = [(k, pos, rng.choice((1, 2, 4)), rng.random() < 0.3) for k in range(60) for pos in range(1, rng.randint(2, 6))]
    log = [(rng.randint(0, 62), rng.randint(0, 7), rng.choice(("before", "after", "delete", "other", None)), seq) for seq in range(400)]
    want = []
    for k in range(60):
        own = {pos: (d, rest) for m, pos, d, rest in beats if m == k}
        gone = {pos for m, pos, op, _ in log if m == k and op == "delete"}
        rows = [(2 * pos, -1, *x) for pos, x in own.items() if pos not in gone]
        rows += [(2 * pos + (1 if op == "after" else -1), seq, own[pos][0], True) for m, pos, op, seq in log if m == k and pos in own and op in ("before", "after")]
        want += [(k, d, rest, i) for i, (_, _, d, rest) in enumerate(sorted(rows) or [(0, 0, 1, True)], 1)]
    b = spark.createDataFrame(beats, "m long, pos long, duration long, rest boolean")
    e = spark.createDataFrame(log, "m long, pos long, op string, seq long")
    for rows_per_chunk in (1 << 20, 2):
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", rows_per_chunk)
        got = edits.insert_and_delete(b, e, ["m"])
        assert sorted((r.m, r.duration, r.rest, r.number) for r in got.collect()) == sorted(want)
    whole, cut = _cut_or_not(spark, monkeypatch, "ed6_insert_and_delete")
    assert len(whole) > 6000 and whole == cut


def test_documents_of_linked_tracks_are_made_where_a_piece_is(spark, monkeypatch):
    from conftest import SMALL
    from scorelake.operators import ordered
    from scorelake.plans import inputs
    from scorelake.sources import tables

    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 500)
    made = []
    docs = tables.by_notes(spark, SMALL, lambda notes: made.append(inputs.linked_documents_of(notes)) or made[-1])
    assert len(made) == 2 and _exchanges(made[0]) == 2  # of the marks, and of the notes of pieces that were not cut
    assert _exchanges(inputs.linked_documents(spark, SMALL)) > 2
    text = lambda df: sorted((r.piece, r.xml) for r in df.collect())
    assert text(docs) == text(inputs.linked_documents(spark, SMALL))
