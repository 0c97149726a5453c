"""Segments, runs, spans and composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ordered import (
    latest,
    number_islands,
    previous,
    running_sum,
    scan,
)


def column_change(a: Column, b: Column, rows: int, cols: int, delta: float) -> Column:
    """Share of columns in which at least two rows change by more than ``delta``. ``a`` and
    ``b`` hold ``rows * cols`` values, row by row."""

    def changed(c: Column) -> Column:
        def moved(r: Column) -> Column:
            i = (r * cols + c).cast("int")
            return F.abs(F.get(a, i).cast("double") - F.get(b, i).cast("double")) > delta

        return F.size(F.filter(F.sequence(F.lit(0), F.lit(rows - 1)), moved)) >= 2

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(cols - 1)), changed)) / F.lit(cols)


def stable_segments(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: str,
    value: str,
    threshold: float,
    step: int,
    shortest: int,
) -> DataFrame:
    """Runs of samples without a jump of ``threshold`` or more in ``value``; a run ends one
    sampling step after its last sample. Runs shorter than ``shortest`` are dropped."""
    runs = number_islands(
        df,
        keys,
        [t, tie],
        lambda prev: F.abs(F.col(value) - prev["v"]) >= threshold,
        {"v": F.col(value)},
        "seg",
    )
    return (
        runs.groupBy(*keys, "seg")
        .agg(
            F.min(t).alias("start_us"),
            (F.max(t) + step).alias("end_us"),
            F.count("*").alias("n"),
        )
        .where(F.col("end_us") - F.col("start_us") >= shortest)
    )


def picks(start: Column, end: Column, most: int) -> Column:
    """Up to ``most`` evenly spaced whole positions from ``start`` to ``end``, half to even."""
    k = F.least(end - start + 1, F.lit(most).cast("long"))
    gap = (end - start) / (k - 1)
    spaced = F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1),
        lambda i: F.when(k == 1, start).otherwise(
            F.bround(start.cast("double") + i * gap, 0).cast("long")
        ),
    )
    return F.array_distinct(spaced)


def median_composite(members: Column, size: int) -> Column:
    """Element-wise median (cut to whole numbers) of a short list of ``(idx, vec)`` members in
    order. With one or two members: the member nearest to the median, the first on a tie."""
    n = F.size(members)

    def middle(p: Column) -> Column:
        v = F.array_sort(F.transform(members, lambda m: F.get(m["vec"], p)))
        low = F.get(v, F.floor((n - 1) / 2).cast("int"))
        high = F.get(v, F.floor(n / 2).cast("int"))
        return F.floor((low + high) / 2)

    med = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), middle)

    def error(m: Column) -> Column:
        return F.aggregate(
            F.zip_with(m["vec"], med, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    nearest = F.array_min(
        F.transform(members, lambda m: F.struct(error(m).alias("e"), m["idx"].alias("i"), m["vec"]))
    )
    return F.when(n >= 3, med).otherwise(nearest["vec"])


def pixel_runs(df: DataFrame, keys: Sequence[str], x: str, gap: int) -> DataFrame:
    """Numbers runs of positions; a jump of more than ``gap`` starts a new run.

    Positions are pixels and are made distinct first, so a key holds at most one image
    width of them and a plain window is enough."""
    w = Window.partitionBy(*keys).orderBy(x)
    places = df.select(*keys, x).distinct()
    jump = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("long"), F.lit(1).cast("long"))
    return places.withColumn("_jump", jump).withColumn("run", F.sum("_jump").over(w)).drop("_jump")


def longest_run(df: DataFrame, keys: Sequence[str], x: str, gap: int) -> DataFrame:
    """``[a, b)`` of the longest run with gaps up to ``gap`` bridged, the first on a tie."""
    runs = pixel_runs(df, keys, x, gap + 1).groupBy(*keys, "run").agg(
        F.min(x).alias("a"), F.max(x).alias("z")
    )
    return (
        runs.groupBy(*keys)
        .agg(F.max_by(F.struct("a", "z"), F.struct(F.col("z") - F.col("a"), -F.col("a"))).alias("r"))
        .select(*keys, F.col("r.a").alias("a"), (F.col("r.z") + 1).alias("b"))
    )


def edge_spans(
    df: DataFrame, keys: Sequence[str], x: str, width: int, lead: int, narrowest: int
) -> DataFrame:
    """Spans between distinct edges: one before the first edge when it lies beyond ``lead``,
    the last one up to ``width``; spans narrower than ``narrowest`` are dropped."""
    w = Window.partitionBy(*keys).orderBy(x)
    edges = df.select(*keys, x).distinct()
    inner = edges.select(
        *keys, F.col(x).alias("a"), F.lead(x, 1, width).over(w).alias("b")
    )
    head = (
        edges.groupBy(*keys)
        .agg(F.min(x).alias("b"))
        .where(F.col("b") > lead)
        .select(*keys, F.lit(0).cast("long").alias("a"), "b")
    )
    return inner.unionByName(head).where(F.col("b") - F.col("a") >= narrowest)


def highlight_periods(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, a: str, b: str
) -> DataFrame:
    """Periods of the same highlighted span: the next span that is not null belongs to the
    period while it overlaps the one before by more than 0.6 of the shorter. The span of a
    period is the median of its members at least 0.9 times as wide as the widest."""
    lit_rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    overlap = lambda p: F.least(p["b"], F.col(b)) - F.greatest(p["a"], F.col(a))
    shorter = lambda p: F.least(p["b"] - p["a"], F.col(b) - F.col(a))
    runs = number_islands(
        lit_rows,
        keys,
        [t, tie],
        lambda p: ~(overlap(p) * 10 > shorter(p) * 6),
        {"a": F.col(a), "b": F.col(b)},
        "period",
    )
    # members of a period are counted per distinct span: pixels, so few per period
    spans = runs.groupBy(*keys, "period", a, b).agg(
        F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1")
    )
    w = Window.partitionBy(*keys, "period")
    wide = (F.col(b) - F.col(a)) * 10 >= F.max(F.col(b) - F.col(a)).over(w) * 9
    return (
        spans.withColumn("_wide", wide)
        .groupBy(*keys, "period")
        .agg(
            F.percentile(F.when(F.col("_wide"), F.col(a)), 0.5, F.col("n")).cast("long").alias("x0"),
            F.percentile(F.when(F.col("_wide"), F.col(b)), 0.5, F.col("n")).cast("long").alias("x1"),
            F.min("t0").alias("start_t"),
            F.max("t1").alias("end_t"),
        )
    )


def overlap_strips(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], shift: Column, linked: Column
) -> DataFrame:
    """Joins neighbours into strips. ``linked`` tells whether a row overlaps the row before,
    ``shift`` how far a row's right neighbour is moved. Adds ``strip`` and ``x``."""
    base = df.withColumns({"_shift": shift, "_linked": linked})
    step = scan(base, keys, order, {"_moved": previous(F.col("_shift"))}, keep=True)
    starts = F.col("_moved").isNull() | ~F.col("_linked")
    step = step.withColumns(
        {"_s": starts.cast("long"), "_m": F.when(starts, F.lit(0)).otherwise(F.col("_moved"))}
    )
    summed = scan(
        step, keys, order, {"strip": running_sum(F.col("_s")), "_far": running_sum(F.col("_m"))},
        keep=True,
    ).withColumn("_at", F.when(F.col("_s") == 1, F.col("_far")))
    placed = scan(summed, keys, order, {"_zero": latest(F.col("_at"))})
    return placed.withColumn("x", F.col("_far") - F.col("_zero")).drop(
        "_shift", "_linked", "_moved", "_s", "_m", "_far", "_at", "_zero"
    )


def cuts(width: Column, step: int) -> Column:
    """Starts of fixed-width cuts of ``[0, width)``."""
    return F.when(
        width > 0, F.sequence(F.lit(0).cast("long"), width - 1, F.lit(step).cast("long"))
    ).otherwise(F.array().cast("array<bigint>"))


def reach(df: DataFrame, keys: Sequence[str], x: str, gap: int, limit: int) -> DataFrame:
    """From the first position outwards: the last one before more than ``gap`` blank places,
    and whether the run was still open at ``limit``."""
    runs = pixel_runs(df.where(F.col(x) < limit), keys, x, gap + 1)
    return (
        runs.where("run = 1")
        .groupBy(*keys)
        .agg(F.max(x).alias("last_x"))
        .withColumn("open_", F.col("last_x") + gap + 1 >= limit)
    )
