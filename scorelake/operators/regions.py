"""Boxes around detections, panels and region consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.intervals import hits, merged, overlap_join, support
from scorelake.operators.ordered import apart, cut_columns, spread_over


def _ends(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.max("s")
    return df.groupBy(*keys).agg(
        (F.median("x0") - s).cast("long").alias("x0"),
        (F.median("x1") + s).cast("long").alias("x1"),
        (F.min("top") - 3 * s).cast("long").alias("y0"),
        (F.max("bottom") + 3 * s).cast("long").alias("y1"),
    )


def _inside(width: int, height: int) -> dict[str, Column]:
    """The box of the ends ``x0, x1, y0, y1``."""
    zero = F.lit(0).cast("long")
    x, y = F.greatest(zero, "x0"), F.greatest(zero, "y0")
    return {
        "x": x, "y": y,
        "w": F.least(F.lit(width).cast("long"), "x1") - x,
        "h": F.least(F.lit(height).cast("long"), "y1") - y,
    }


def box_around(df: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """One box per key: median left and right edge with a space to spare, all rows with three
    spaces to spare, inside the frame. Pixel values are counted, so medians stay small."""
    return _ends(df, keys).select(*keys, *(v.alias(k) for k, v in _inside(width, height).items()))


def panel_rows(values: Column, rows: int, cols: int, tolerance: int, share: float) -> Column:
    """First and last row in which at least ``share`` of the values lie near the median."""
    ranked = F.array_sort(values)
    half = rows * cols // 2
    mid = (F.get(ranked, F.lit(half - 1)) + F.get(ranked, F.lit(half))) / 2

    def flat(r: Column) -> Column:
        row = F.slice(values, r * cols + 1, F.lit(cols))
        return F.size(F.filter(row, lambda v: F.abs(v - mid) < tolerance)) / F.lit(cols) >= share

    found = F.filter(F.sequence(F.lit(0), F.lit(rows - 1)), flat)
    return F.struct(
        F.coalesce(F.array_min(found), F.lit(0)).cast("long").alias("top"),
        F.coalesce(F.array_max(found), F.lit(rows - 1)).cast("long").alias("bottom"),
    )


def _changes(col: pa.Array) -> np.ndarray:
    """Rows of a sorted column that differ from the row before (nulls are equal), and the first one."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    one_null = pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], differ | one_null])


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``key``, cut anew so that none ends within a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        at = int(np.flatnonzero(_changes(batch.column(key)))[-1])
        last = held[-1].column(key).slice(len(held[-1]) - 1) if held else None
        if held and _changes(pa.concat_arrays([last, batch.column(key).slice(0, 1)]))[1]:
            yield pa.concat_batches(held)
            held = []
        if at:
            yield pa.concat_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def _agreed(frame: np.ndarray, frames: int, v: dict[str, np.ndarray], given: dict[str, np.ndarray]) -> tuple | None:
    """Box and number of hit frames of one video whose detections are sorted by frame and top; none without a stable one."""
    top, bottom, lines = v["top"], v["bottom"], v["lines"]
    stable = (hits(frame, top, bottom) * 2 >= frames) & given["lines"]
    if not stable.any():
        return None
    kept = stable & (lines == lines[stable].max())
    a, b = top[kept], bottom[kept]
    order = np.argsort(a)
    a, far = a[order], np.maximum.accumulate(b[order])
    at = np.searchsorted(a, bottom, "right") - 1  # of the kept ones that begin before its end, one ends behind its start
    hit = (at >= 0) & (far[at] >= top)
    x0, x1, s = (v[k][kept & given[k]] for k in ("x0", "x1", "s"))
    space = s.max() if len(s) else None
    ends = [None if space is None or not len(x) else int(np.median(x) + by * space) for x, by in ((x0, -1), (x1, 1))]
    tall = [None, None] if space is None else [int(a[0] - 3 * space), int(far[-1] + 3 * space)]
    return (*ends, *tall, len(np.unique(frame[hit])))


def _short_videos(rows: DataFrame, video: str, frame: str) -> DataFrame:
    """(video, ``_all`` frames, ends of the box, ``_hit`` frames) of videos that one task holds: rows meet once, by video."""
    fields = ("top", "bottom", "lines", "x0", "x1", "s")
    out = ("x0", "x1", "y0", "y1", "_hit")

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, video):
            starts = _changes(batch.column(video))
            new = starts | _changes(batch.column(frame))
            numbers = np.cumsum(new)
            known = new & batch.column(frame).is_valid().to_numpy(zero_copy_only=False)
            lo = np.flatnonzero(starts)
            counts = np.add.reduceat(known.astype(np.int64), lo)
            seen = batch.column("top").is_valid().to_numpy(zero_copy_only=False)
            given = {k: batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in fields}
            values = {k: batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in fields}
            found = []
            for a, b, n in zip(lo.tolist(), [*lo[1:].tolist(), len(batch)], counts.tolist(), strict=True):
                here = np.flatnonzero(seen[a:b]) + a
                pick = lambda of: {k: x[here] for k, x in of.items()}
                found.append((len(here) and _agreed(numbers[here], n, pick(values), pick(given))) or (None,) * len(out))
            cols = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(video).take(pa.array(lo)), pa.array(counts), *cols], names=[video, "_all", *out])

    kind = dict(rows.dtypes)[video]
    whole = spread_over(rows, [video]).sortWithinPartitions(video, frame, "top")
    return whole.mapInArrow(agreed, f"{video} {kind}, _all long, " + ", ".join(f"{x} long" for x in out))


def _long_videos(staves: DataFrame, frames: DataFrame, video: str, frame: str, bucket: int) -> DataFrame:
    """The same by joins and counts, for videos of any size."""
    total = frames.groupBy(video).agg(F.count_distinct(frame).alias("_all"))
    hit_by = support(staves, [video], frame, "top", "bottom")
    stable = staves.join(hit_by, [video, "top", "bottom"]).join(total, video).where(
        F.col("frames") * 2 >= F.col("_all")
    )
    most = stable.groupBy(video).agg(F.max("lines").alias("lines"))
    kept = stable.join(most, [video, "lines"])
    ends = _ends(kept, [video])
    spans = merged(kept, [video], "top", "bottom").withColumnsRenamed({"top": "_s", "bottom": "_e"})
    own = merged(staves, [video, frame], "top", "bottom")
    seen = overlap_join(own, spans, [video], ("top", "bottom"), ("_s", "_e"), bucket, closed=True)
    share = seen.groupBy(video).agg(F.count_distinct(frame).alias("_hit"))
    return total.join(ends, video, "left").join(share, video, "left").select(video, "_all", "x0", "x1", "y0", "y1", "_hit")


def region_consensus(
    staves: DataFrame, frames: DataFrame | None, video: str, frame: str, width: int, height: int, bucket: int,
    order: Sequence[str] = (),
) -> DataFrame:
    """The region all frames of a video agree on, with the share of frames that hit it.

    A detection ``[top, bottom]`` is stable when some detection overlaps it in half of the
    frames; of the stable ones those with most lines count. Without any the lowest third of
    the frame is returned with confidence 0. Without ``frames`` a video has those of its staves.

    Rows of a video meet once; videos that have a mark (one row in a million, told apart by ``frame`` and ``order``) are
    too long for that and take joins. Rows without a place tell of their frame alone."""
    fields = ("top", "bottom", "lines", "x0", "x1", "s")
    there = F.col(video).isNotNull() & F.col(frame).isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull()
    rows = staves.select(video, frame, *(F.when(there, F.col(k).cast("long")).alias(k) for k in fields), *order)
    if frames is not None:
        rows = rows.unionByName(frames.select(video, frame).distinct(), allowMissingColumns=True)
    short, long = apart(rows, video, [frame, *order])
    found = _short_videos(short.drop(*cut_columns(short), *order), video, frame)
    if long is not None:
        long = long.select(video, frame, *fields)
        found = found.union(_long_videos(long.where("top is not null"), long.select(video, frame), video, frame, bucket))
    third = height * 2 // 3
    box = {k: F.when(F.col("_hit").isNotNull(), v) for k, v in _inside(width, height).items()}
    return found.select(
        video,
        F.coalesce(box["x"], F.lit(0)).alias("x"),
        F.coalesce(box["y"], F.lit(third).cast("long")).alias("y"),
        F.coalesce(box["w"], F.lit(width).cast("long")).alias("w"),
        F.coalesce(box["h"], F.lit(height - third).cast("long")).alias("h"),
        F.coalesce(F.col("_hit") / F.col("_all"), F.lit(0.0)).alias("confidence"),
    )
