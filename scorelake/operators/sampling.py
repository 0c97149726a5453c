"""Rate sampling and as-of lookups over ordered streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ordered import latest, scan, upcoming


def first_per_cell(
    df: DataFrame, keys: Sequence[str], t: str, step: Column | int, tie: str
) -> DataFrame:
    """Keeps the first row of every grid cell of width ``step`` (all in microseconds, one
    microsecond of slack). An aggregate, so rows are dropped before the exchange."""
    step = F.lit(step) if isinstance(step, int) else step
    cell = F.floor((F.col(t) + 1) / step)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return (
        df.groupBy(*keys, cell.alias("_cell"))
        .agg(F.min_by(row, F.struct(t, tie)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def spread(df: DataFrame, keys: Sequence[str], t: str, count: int, tie: str) -> DataFrame:
    """About ``count`` rows spread evenly over each key, never more."""
    length = df.groupBy(*keys).agg(F.max(t).alias("_length"))
    step = F.when(F.col("_length") >= count, F.expr(f"_length div {count}")).otherwise(1_000_000)
    sampled = first_per_cell(
        df.join(length, keys).withColumn("_step", step).drop("_length"),
        [*keys, "_step"],
        t,
        F.col("_step"),
        tie,
    )
    w = Window.partitionBy(*keys).orderBy(t, tie)  # at most count + 1 rows by now
    return (
        sampled.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n", "_step")
    )


def neighbours(
    probes: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    take: Sequence[str],
    rows_first: bool,
) -> DataFrame:
    """Each probe with the row before and after it as structs ``before`` and ``after``.

    ``rows_first``: a row at the probe's own place counts as before it, else as after it.
    Probes and rows are merged into one order and scanned, so nothing is paired up."""
    take = [c for c in take if c != at]
    value = F.struct(F.col(at), *[F.col(c) for c in take])
    p = probes.select(*keys, at, tie, F.lit(1 if rows_first else 0).alias("_side"), F.struct(*[
        c for c in probes.columns if c not in (*keys, at, tie)]).alias("_probe") if len(
            [c for c in probes.columns if c not in (*keys, at, tie)]) else F.lit(True).alias("_probe"))
    r = rows.select(*keys, at, tie, F.lit(0 if rows_first else 1).alias("_side"), value.alias("_row"))
    both = p.unionByName(r, allowMissingColumns=True)
    seen = scan(
        both,
        keys,
        [at, "_side", tie],
        {"before": latest(F.col("_row")), "after": upcoming(F.col("_row"))},
    )
    extra = [c for c in probes.columns if c not in (*keys, at, tie)]
    return seen.where(F.col("_probe").isNotNull()).select(
        *keys, at, tie, *[F.col("_probe")[c].alias(c) for c in extra], "before", "after"
    )


def at_or_after(
    probes: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, tie: str, take: Sequence[str]
) -> DataFrame:
    """The first row at or after each probe, else the last row of the key, as ``found``."""
    near = neighbours(probes, rows, keys, at, tie, take, rows_first=False)
    return near.withColumn("found", F.coalesce("after", "before")).drop("before", "after")


def nearest(
    probes: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, tie: str, take: Sequence[str]
) -> DataFrame:
    """The nearest row to each probe (the lower one on a tie) as ``found``."""
    near = neighbours(probes, rows, keys, at, tie, take, rows_first=True)
    low = F.col(at) - F.col("before")[at]
    high = F.col("after")[at] - F.col(at)
    found = (
        F.when(F.col("before").isNull(), F.col("after"))
        .when(F.col("after").isNull() | (low <= high), F.col("before"))
        .otherwise(F.col("after"))
    )
    return near.withColumn("found", found).drop("before", "after")
