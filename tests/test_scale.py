"""Folds against plain loops, cut keys, hot keys, blocks, streams."""

import json
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from conftest import SMALL, as_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scorelake.operators import alignment, clusters, ordered, tracking
from scorelake.operators.repair import repaired_numbers
from scorelake.streaming import streams

FOLDS = [
    "seq9_merge_adjacent_similar", "seq17_median_beats", "seq18_text_runs", "seq19_even_gap_groups", "str1_tracks",
    "str2_moving_tracks", "str7_screens_merged", "udf1_repaired_numbers",
]


@pytest.mark.parametrize("name", FOLDS)
def test_cut_fold_gives_the_same_rows(name, spark, monkeypatch):
    query = entry.queries()[name]
    whole = query(spark, SMALL)
    want = as_rows(whole.columns, whole.collect())
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 4)
    cut = query(spark, SMALL)
    assert as_rows(cut.columns, cut.collect()) == want


def test_a_hot_key_is_split(spark):
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000 + 1).alias("k"), F.col("id").alias("t")
    )
    cut = ordered.chunked(df, "k", "t", rows=500)
    sizes = cut.groupBy("k", ordered.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes < 8 * 500
    got = ordered.scan(df, "k", "t", {"n": ordered.row_number(), "p": ordered.previous(F.col("t"))}, rows=500)
    hot = got.where("k = 0")
    assert hot.where("n <> t div 3 + 1").count() == 0
    assert hot.where("t > 0 and p <> t - 3 or t > 0 and p is null").count() == 0


def test_copies_are_split_by_their_row_id(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.xxhash64("id").alias("rid"))
    sizes = ordered.chunked(df, "k", ["t", "rid"], rows=500).groupBy(ordered.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes < 8 * 500
    numbered = ordered.scan(df, "k", ["t", "rid"], {"n": ordered.row_number()}, rows=500)
    r = numbered.agg(F.count_distinct("n"), F.max("n")).first()
    assert tuple(r) == (20_000, 20_000)


def test_windows_of_a_hot_key_run_per_chunk(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    out = ordered.scan(df, "k", "t", {"n": ordered.row_number()}, rows=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_chunk" in line for line in windows)


def _viterbi(readings):
    """Plain form: best offset per place by dynamic programming over all offsets."""
    votes = [(n, round(q * 1000) * 2) if n is not None and q >= 0.5 else (None, 0) for n, q in readings]
    offsets = sorted({n - i for i, (n, _) in enumerate(votes) if n is not None} or {1})
    gain = lambda i, o: 0 if votes[i][0] is None else (votes[i][1] if votes[i][0] == i + o else -votes[i][1] // 2)
    score, ways = {o: gain(0, o) for o in offsets}, []
    for i in range(1, len(votes)):
        top = max(offsets, key=lambda o: (score[o], -o))
        way = {o: o if score[o] >= score[top] - 5000 else top for o in offsets}
        score = {o: max(score[o], score[top] - 5000) + gain(i, o) for o in offsets}
        ways.append(way)
    o = max(offsets, key=lambda o: (score[o], -o))
    path = [o]
    for way in reversed(ways):
        path.append(way[path[-1]])
    return [i + o for i, o in enumerate(reversed(path))]


@pytest.mark.parametrize("chunk", [None, 3])
def test_number_repair(spark, monkeypatch, chunk):
    rng = random.Random(5)
    pieces = {}
    for p in range(25):
        offset, rows = rng.randrange(1, 30), []
        for i in range(rng.randrange(1, 60)):
            if rng.random() < 0.05:
                offset += rng.choice([-2, 3, 4])
            n = i + offset + (rng.choice([0, 0, 0, 10, -1]) if rng.random() < 0.4 else 0)
            rows.append((n if rng.random() < 0.7 else None, rng.randrange(300, 1000) / 1000))
        pieces[p] = rows
    df = spark.createDataFrame(
        [(p, i, n, q) for p, rows in pieces.items() for i, (n, q) in enumerate(rows)],
        "piece long, place long, number long, conf double",
    )
    if chunk:
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", chunk)
    got: dict = {}
    for r in repaired_numbers(df, ["piece"], "place", "number", "conf").orderBy("piece", "place").collect():
        got.setdefault(r.piece, []).append(r.number)
    assert got == {p: _viterbi(rows) for p, rows in pieces.items()}


def test_blocks_give_the_same_alignment(spark):
    rng = random.Random(3)
    rows_g, rows_p = [], []
    for piece, (n, m) in enumerate([(1, 1), (9, 7), (4, 12), (13, 13), (0, 3), (3, 0)]):
        rows_g += [(piece, i, [rng.choice("abc") for _ in range(3)]) for i in range(n)]
        rows_p += [(piece, i, [rng.choice("abc") for _ in range(3)]) for i in range(m)]
    schema = "piece long, i long, items array<string>"
    g, p = spark.createDataFrame(rows_g, schema), spark.createDataFrame(rows_p, schema)
    want = alignment.align_measures(g, p, "piece")
    got = alignment.align_measures(g, p, "piece", block=4)
    assert as_rows(got.columns, got.collect()) == as_rows(want.columns, want.collect())
    assert want.where("piece = 4").count() == 3 and want.where("piece = 5").count() == 3


def test_bitmaps_agree_with_the_stream_form(spark):
    from scorelake.functions import boxes

    rng = random.Random(1)
    words = [(rng.getrandbits(63) & rng.getrandbits(63), rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63)) for _ in range(200)]
    words += [(0, 0), (0, 1), (-1, -1), (-(1 << 63), 1 << 62)]
    df = spark.createDataFrame(words, "a long, b long")
    got = [r.m for r in df.select(boxes.mismatch(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == pytest.approx([tracking.word_mismatch(a, b) for a, b in words])


def _sorted_rows(df, kind):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["str1_tracks", "str2_moving_tracks", "str3_segments", "str4_sampled"])
def test_stream_equals_batch(spark, kind):
    """A table of four files with shuffled rows, read in any order, gives the rows of the batch form, all of them."""
    from scorelake.plans import QUERIES

    folder = f"{tempfile.mkdtemp(prefix='spark-')}"
    table = pq.read_table(f"{SMALL}/events.parquet")
    order = list(range(table.num_rows))
    random.Random(4).shuffle(order)
    import os

    os.mkdir(f"{folder}/events.parquet")
    for k in range(4):
        pq.write_table(table.take(order[k::4]), f"{folder}/events.parquet/part-{k}.parquet")
    got = QUERIES[f"{kind}_stream"](spark, folder)
    want = QUERIES[f"{kind}_stream" if kind == "str4_sampled" else kind](spark, SMALL)
    assert _sorted_rows(got, kind) == _sorted_rows(want, kind)


def test_changes_are_worked_out_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(1,), (2,)], "piece long").write.parquet(f"{folder}/in")
    changes = spark.readStream.schema("piece long").parquet(f"{folder}/in")
    q = streams.on_changes(changes, lambda b: b.distinct().withColumn("done", F.lit(True)), f"{folder}/out", f"{folder}/state")
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_text_documents_are_written_in_order(spark):
    from scorelake.sources.sinks import write_documents

    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.range(300).select((F.col("id") % 7).alias("piece"), F.col("id").alias("measure"), F.concat(F.lit("m"), "id").alias("line_"))
    write_documents(df, "piece", "measure", "line_", f"{folder}/doc")
    import glob

    lines = [json.loads(x) for f in sorted(glob.glob(f"{folder}/doc/part-*")) for x in open(f)]
    assert [(x["piece"], x["measure"]) for x in lines] == sorted((x["piece"], x["measure"]) for x in lines)
    assert len(lines) == 300


def test_measure_files(spark):
    from scorelake.sources.documents import read_measure_files

    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.xml", "w") as f:
        f.write('<score-partwise><part><measure number="1"><note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration></note></measure>'
                '<measure number="2"><note><duration>4</duration></note><note><duration>1</duration></note></measure></part></score-partwise>')
    rows = read_measure_files(spark, folder).orderBy("_number").collect()
    assert [(r._number, [n.duration for n in r.note]) for r in rows] == [(1, [2]), (2, [4, 1])]


def test_beats_against_a_plain_loop(spark):
    import statistics

    rng = random.Random(9)
    xs = sorted(rng.randrange(400) for _ in range(300))
    groups: list[list[int]] = []
    for x in xs:
        if groups and abs(x - statistics.median(groups[-1])) <= 12:
            groups[-1].append(x)
        else:
            groups.append([x])
    df = spark.createDataFrame([("f", x) for x in xs], "frame string, x long")
    places = [r.places for r in clusters.beat_places(df, ["frame"], "x", 12).collect()]
    assert {p[0].x: sum(q.n for q in p) for p in places} == {g[0]: len(g) for g in groups}


@pytest.mark.parametrize("name", ["jn21_dots_to_beats", "jn22_kept_rests"])
def test_positions_spread_over_pixels_are_not_broadcast(spark, name):
    """Each row spread over a band of pixels was estimated by the rows before, and sent whole through the driver."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan.replace("sequence(cast(FLOOR", "").replace("sequence(FLOOR", "")
    assert "BroadcastExchange" not in plan or name != "jn22_kept_rests"


def test_a_stream_asks_its_store_by_cell_not_by_row(spark):
    """Rows of a key at 200 times and in two batches: a few rows of state, one timer."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(0).alias("item"), (F.col("id") % 7 * 20.0).alias("value"), F.timestamp_millis("id").alias("ts"))
    for part in (0, 1):
        rows.where(f"t % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = streams.with_end(streams.table_stream(spark, f"{folder}/in"), "ts", 1000)
    out = streams.stream_fold(source, "k", 1, ["t", "item", "value"], tracking.Segmenter, "a long, z long, n long")
    query = out.writeStream.format("memory").queryName("few_calls").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    with streams.state_store(spark):
        run = query.start()
        run.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 8
