"""Interval joins and nearest-neighbour rules in pixel space.

Detections of one frame are reduced to distinct pixel positions before they meet, so a
frame holds at most one image width of them however often a position repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ordered import running_max, scan
from scorelake.operators.sampling import neighbours


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l: tuple[str, str],
    r: tuple[str, str],
    bucket: int,
    closed: bool = False,
) -> DataFrame:
    """Pairs whose intervals overlap. Both sides are spread over the buckets they touch and
    joined on the bucket; a pair is kept only in the first bucket both touch."""

    def spread(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        lo, hi = F.floor(F.col(ends[0]) / bucket), F.floor(F.col(ends[1]) / bucket)
        return df.withColumn("_b", F.explode(F.sequence(lo, hi)))

    pairs = spread(left, l).join(spread(right, r), [*keys, "_b"])
    if closed:
        hit = (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
    else:
        hit = (F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0]))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / bucket)
    return pairs.where(hit & (F.col("_b") == first)).drop("_b")


def within(
    probes: DataFrame, rows: DataFrame, keys: Sequence[str], lo: Column, hi: Column, at: str, span: int
) -> DataFrame:
    """Probes with the rows whose whole position ``at`` lies in ``[lo, hi]``, a range of at most
    ``span`` pixels: a probe goes to the one or two cells of that width it touches, a row to
    its own."""
    cell = lambda x: F.floor(x / span)
    p = probes.withColumns({"_lo": lo, "_hi": hi})
    p = p.withColumn("_b", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    near = p.join(rows.withColumn("_b", cell(F.col(at))), [*keys, "_b"])
    return near.where(F.col(at).between(F.col("_lo"), F.col("_hi"))).drop("_b", "_lo", "_hi")


def best_overlap(
    spans: DataFrame, numbered: DataFrame, keys: Sequence[str], number: str, bucket: int
) -> DataFrame:
    """Each span ``[x0, x1)`` with the number of the span ``[a, b)`` it overlaps most (the
    first on a tie), null when there is none."""
    pairs = overlap_join(spans, numbered, keys, ("x0", "x1"), ("a", "b"), bucket)
    size = F.least("x1", "b") - F.greatest("x0", "a")
    best = pairs.groupBy(*keys, "x0", "x1").agg(
        F.max_by(F.col(number), F.struct(size, -F.col("a"))).alias(number)
    )
    return spans.join(best, [*keys, "x0", "x1"], "left")


def inside_any(
    points: DataFrame, extents: DataFrame, keys: Sequence[str], at: str, tie: str
) -> DataFrame:
    """Adds ``inside``: some extent ``[lo, hi]`` holds the point. Extents and points are merged
    into one order; the furthest end so far decides, so nothing is paired up."""
    p = points.select(*keys, at, tie, F.lit(1).alias("_side"))
    e = extents.select(*keys, F.col("lo").alias(at), F.lit(0).alias("_side"), F.col("hi").alias("_hi"))
    both = p.unionByName(e, allowMissingColumns=True).withColumn(tie, F.coalesce(tie, F.lit(-1)))
    seen = scan(both, keys, [at, "_side", tie], {"_far": running_max(F.col("_hi"))})
    return seen.where("_side = 1").select(
        *keys, at, tie, F.coalesce(F.col("_far") >= F.col(at), F.lit(False)).alias("inside")
    )


def snap(
    spans: DataFrame, bars: DataFrame, keys: Sequence[str], s: int
) -> DataFrame:
    """Widens spans ``[x0, x1]`` to the bars ``x`` right at their ends: the last one in
    ``[x0 - s, x0 + 0.6 s]`` and the first one in ``[x1 - 0.6 s, x1 + s]`` beyond
    ``x0 + 2 s``. ``whole``: both were there."""
    near = 6 * s // 10
    tie = F.lit(0).cast("long")
    bars = bars.select(*keys, "x").distinct().withColumn("tie", tie)
    spans = spans.select(*keys, "x0", "x1").distinct()
    left = neighbours(
        spans.withColumns({"x": F.col("x0") + near, "tie": F.col("x1")}),
        bars, keys, "x", "tie", [], rows_first=True,
    ).select(*keys, "x0", "x1", F.col("before.x").alias("l"))
    right = neighbours(
        spans.withColumns(
            {"x": F.greatest(F.col("x1") - near, F.col("x0") + 2 * s + 1), "tie": F.col("x0")}
        ),
        bars, keys, "x", "tie", [], rows_first=False,
    ).select(*keys, "x0", "x1", F.col("after.x").alias("r"))
    both = left.join(right, [*keys, "x0", "x1"])
    lo = F.when(F.col("l") >= F.col("x0") - s, F.col("l"))
    hi = F.when(F.col("r") <= F.col("x1") + s, F.col("r"))
    return both.select(
        *keys, "x0", "x1",
        F.coalesce(lo, "x0").alias("left_x"),
        F.coalesce(hi, "x1").alias("right_x"),
        (lo.isNotNull() & hi.isNotNull()).alias("whole"),
    )


def consecutive(df: DataFrame, keys: Sequence[str], x: str, cols: Sequence[str]) -> DataFrame:
    """Each place with its right neighbour of the same key as struct ``next`` (distinct places)."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("next", F.lead(F.struct(x, *cols)).over(w))


def merged(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Closed pixel intervals of a key joined into disjoint ones."""
    ends = df.groupBy(*keys, a).agg(F.max(b).alias(b))
    w = Window.partitionBy(*keys).orderBy(a)
    far = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col(a) <= F.col("_far"), 0).otherwise(1)).over(w)
    return (
        ends.withColumn("_far", far)
        .withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(F.min(a).alias(a), F.max(b).alias(b))
        .drop("_run")
    )


def hits(frame: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each detection ``[a, b]`` of one video the frames in which some detection overlaps it. Detections are sorted
    by frame and start; see ``support`` for the table they are counted in."""
    off = (frame - frame[0]) * (int(b.max()) - int(a.min()) + 2)  # ends of one frame lie before those of the next
    far = np.maximum.accumulate(b + off)
    at = np.flatnonzero(np.concatenate([[True], (a + off)[1:] > far[:-1]]))
    start, end = a[at], far[np.append(at[1:] - 1, len(a) - 1)] - off[at]
    first = np.concatenate([[True], frame[at][1:] != frame[at][:-1]])
    begin = np.where(first, min(int(a.min()), int(b.min())), np.concatenate([[0], end[:-1] + 1]))
    return _counted(np.concatenate([begin, end + 1]), np.tile(start, 2), np.repeat([1, -1], len(at)), a, b)


def _counted(x: np.ndarray, y: np.ndarray, by: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the steps ``by`` at places up to ``(a, b)``."""
    (xs, i), (ys, j) = (np.unique(v, return_inverse=True) for v in (x, y))
    table = np.zeros((len(xs), len(ys)), np.int64)
    np.add.at(table, (i, j), by)
    table = table.cumsum(0).cumsum(1)
    i, j = (np.searchsorted(v, w, "right") - 1 for v, w in ((xs, a), (ys, b)))
    return np.where((i >= 0) & (j >= 0), table[i, j], 0)


def support(df: DataFrame, video: Sequence[str], frame: str, a: str, b: str) -> DataFrame:
    """In how many frames of its video some detection overlaps each distinct detection.

    The spans of a frame are disjoint, so a place ``x`` has one next span, the one that it lies in or the first beyond
    it; a detection is overlapped where the next span of its start begins at its end or before. Over all frames these
    are counted by pixels: each span adds one to the places from behind the span before it up to its own end. So a video
    is one table of at most as many counts as an image has places for starts and ends, summed up along both sides,
    however many frames and detections there are. Videos travel as one row each, many to a batch."""
    keys = list(video)
    spans = merged(df, [*keys, frame], a, b).withColumnsRenamed({a: "_s", b: "_e"})
    w = Window.partitionBy(*keys, frame).orderBy("_s")
    spans = spans.withColumn("_from", F.coalesce(F.lag("_e").over(w) + 1, F.lit(-(1 << 40))))
    step = lambda at, by: F.struct(F.col(at).cast("long").alias("_x"), F.lit(by).cast("long").alias("_by"))
    steps = spans.withColumn("_end", F.col("_e") + 1).select(*keys, F.col("_s").cast("long").alias("_y"), F.inline(F.array(step("_from", 1), step("_end", -1))))
    steps = steps.groupBy(*keys, "_x", "_y").agg(F.sum("_by").alias("_by"))
    kinds = df.select(*keys, F.col(a).cast("long").alias("_x"), F.col(b).cast("long").alias("_y")).distinct().withColumn("_by", F.lit(None).cast("long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_rows")
            ends = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            flat = rows.flatten()
            x, y = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("_x", "_y"))
            by = flat.field("_by").fill_null(0).to_numpy(zero_copy_only=False)
            asked = flat.field("_by").is_null().to_numpy(zero_copy_only=False)
            frames = np.zeros(len(x), np.int64)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                kinds = np.flatnonzero(asked[lo:hi]) + lo
                steps = np.flatnonzero(~asked[lo:hi]) + lo
                frames[kinds] = _counted(x[steps], y[steps], by[steps], x[kinds], y[kinds])
            video = pa.array(np.repeat(np.arange(len(rows)), np.diff(ends))[asked])
            kept = [batch.column(k).take(video) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v[asked]) for v in (x, y, frames))], names=[*keys, "_x", "_y", "frames"])

    names = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    tables = steps.select(*keys, "_x", "_y", "_by").union(kinds).groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y", "_by")).alias("_rows"))
    found = tables.mapInArrow(counted, ", ".join([*names, "_x long", "_y long", "frames long"]))
    return found.withColumnsRenamed({"_x": a, "_y": b})
