"""Ordered scans that do not depend on any key being small.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here the rows of
a key are cut into chunks along the order first: rows whose hashed order value falls on one
residue become cut marks (about one per ``ROWS_PER_CHUNK`` rows, the same ones on every
attempt, so a lost executor changes nothing). Windows then run per (key, chunk), one small
summary row per chunk carries sums and edge values across, and only keys that were really
cut take part in that second step. Both broadcast tables hold at most one row per mark.

The order columns should end in a unique one (``rid`` of a file row, an event id): equal
order values stay in one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from scorelake.session import checkpoint_folder

ROWS_PER_CHUNK = 1 << 20
ROWS_PER_TASK = 1 << 18
CHUNK = "_chunk"  # number of the chunk; -1: this key was not cut
LAST = "_last"  # the last chunk of its key
WHOLE = "_whole"  # stands in place of both when no key at all had a mark


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(dict.fromkeys(cols))


def cut_marks(
    df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], rows: int
) -> DataFrame:
    """Per key with any: the sorted order values that start a new chunk."""
    keys, order = _names(keys), _names(order)
    return (
        df.select(*keys, F.struct(*order).alias("_cut_at"))
        .where(F.pmod(F.xxhash64("_cut_at"), F.lit(rows)) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_cut_at")).alias("_cut_marks"))
    )


def _label(col: Column, name: str, keys: list[str], order: list[str], tasks: int = 0) -> Column:
    return col.alias(name, metadata={"keys": keys, "order": order, "tasks": tasks})


def _cut_for(df: DataFrame, keys: list[str], order: list[str]) -> bool:
    """Whether the cut columns hold for these keys. Rows whose keys are whole stay so in any order, and by finer keys."""
    known = [df.schema[c].metadata for c in cut_columns(df)[:1]]
    if WHOLE in df.columns and any("keys" in k and set(k["keys"]) <= set(keys) for k in known):
        return True
    return any(k.get("keys") == keys and k.get("order") == order for k in known)


def by_rows(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Hashes rows that were cut over as many tasks as their marks tell of rows, one per ``ROWS_PER_TASK``; rows that
    were not stay as they are. Rows that are much alike take few bytes in an exchange and many in a sort, so
    partitions that are merged by bytes grow too large for one task."""
    tasks = tasks_of(df)
    if not tasks:
        return df
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *_names(keys))


def cut_columns(df: DataFrame) -> list[str]:
    return [c for c in (CHUNK, LAST, WHOLE) if c in df.columns]


def relabelled(
    df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]
) -> list[Column]:
    """The cut columns, declared valid for other names of the same keys and order."""
    return [
        _label(F.col(c), c, _names(keys), _names(order), df.schema[c].metadata.get("tasks", 0))
        for c in cut_columns(df)
    ]


def chunked(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    rows: int | None = None,
    among: DataFrame | None = None,
    more: int = 0,
) -> DataFrame:
    """Adds ``_chunk`` (binary search among the marks) and ``_last``, or just ``_whole`` when
    there are no marks. Columns from an earlier call over the same keys and order are used
    again. ``among``: rows that marks are looked for in, where all others are few to a key and
    would have to be worked out first; keys with less than a chunk of them are not cut, and
    ``more`` tasks are counted for the others."""
    keys, order = _names(keys), _names(order)
    if _cut_for(df, keys, order):
        return df
    df, rows = df.drop(*cut_columns(df)), rows or ROWS_PER_CHUNK
    marks = cut_marks(df if among is None else among, keys, order, rows)
    if among is not None:
        here = among.join(F.broadcast(marks.select(*keys)), keys, "left_semi").groupBy(*keys).agg((F.count("*") >= rows).alias("_many"))
        marks = marks.join(F.broadcast(here), keys)
    many = F.lit(True) if among is None else F.col("_many")
    number, cuts = marks.agg(F.sum(F.size("_cut_marks")), F.count_if(many)).first()
    tasks = more if not number else -(-number * rows // ROWS_PER_TASK) + more
    if not cuts:
        return df.select("*", _label(F.lit(True), WHOLE, keys, order, tasks if among is not None else 0))
    marks = marks.where(many).select(*keys, "_cut_marks")
    at = F.struct(*order)
    m = F.col("_cut_marks")
    steps = F.sequence(F.ceil(F.log2(F.size(m) + 1)).cast("int"), F.lit(0), F.lit(-1))
    one = F.lit(1)
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda lo, k: F.when(
            (lo + F.call_function("shiftleft", one, k) <= F.size(m))
            & (F.get(m, lo + F.call_function("shiftleft", one, k) - 1) <= at),
            lo + F.call_function("shiftleft", one, k),
        ).otherwise(lo),
    )
    chunk = F.when(m.isNull(), F.lit(-1)).otherwise(found)
    return (
        df.join(F.broadcast(marks), keys, "left")
        .withColumn("_cut_no", chunk)
        .select(
            *df.columns,
            _label(F.col("_cut_no"), CHUNK, keys, order, tasks),
            _label(m.isNull() | (F.col("_cut_no") == F.size(m)), LAST, keys, order, tasks),
        )
    )


def apart(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that were not cut, and of those that were where there are any: what only one of the two needs
    must not be worked out for the other. Cut keys are gone over many times, so their rows are kept as a checkpoint; the
    others are few to a key, and what is grouped by key and more needs no further exchange."""
    keys, order = _names(keys), _names(order)
    cut = chunked(df, keys, order)
    if WHOLE in cut.columns:
        return cut, None
    short = cut.where(F.col(CHUNK) < 0).drop(CHUNK, LAST).select("*", _label(F.lit(True), WHOLE, keys, order, tasks_of(cut)))
    checkpoint_folder(df.sparkSession)
    return short, cut.where(F.col(CHUNK) >= 0).checkpoint()


def whole_like(df: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows made of ``source`` by these keys, declared whole where those of ``source`` are."""
    keys = _names(keys)
    known = WHOLE in source.columns and source.schema[WHOLE].metadata.get("keys") == keys
    return df.select("*", _label(F.lit(True), WHOLE, keys, [])) if known else df


def backwards(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Rows with the number of their chunk, cut at the same marks for an ``order`` that runs the other way."""
    keys, order = _names(keys), _names(order)
    turned, tasks = F.lit(1 << 30) - F.col(CHUNK), tasks_of(df)
    rest = [x for x in df.columns if x != CHUNK]
    return df.select(*rest, _label(turned, CHUNK, keys, order, tasks), _label(F.col(CHUNK) == 0, LAST, keys, order, tasks))


def spread_over(df: DataFrame, keys: str | Sequence[str], most: int = 0) -> DataFrame:
    """Hashes rows over all shuffle partitions, or ``most`` of them, in front of work that costs more than its bytes
    tell, so that small partitions are not merged."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, most) if most else n, *_names(keys))


def tasks_of(df: DataFrame) -> int:
    """Tasks that the marks of cut rows tell of, some four to a mark, so twice the chunks at least; 0 without marks."""
    return max((f.metadata.get("tasks", 0) for f in df.schema), default=0)


@dataclass(frozen=True)
class Scan:
    """One output of :func:`scan`."""

    local: Callable[[WindowSpec, WindowSpec], Column]  # inside the chunk; forward, backward
    part: Callable[[Column], Column]  # summary of a chunk, given the order struct
    carry: Callable[[str, WindowSpec], Column]  # what the other chunks hand to this one
    merge: Callable[[Column, Column], Column]  # local value and carried value
    edge: str = ""  # "first" / "last": only that row of the chunk takes the carried value


def running_sum(col: Column, inclusive: bool = True) -> Scan:
    """Sum of the rows up to here (integers, so that the order of adding is no matter)."""
    upto = 0 if inclusive else -1
    return Scan(
        lambda w, r: F.coalesce(
            F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, upto)), F.lit(0)
        ),
        lambda at: F.sum(col),
        lambda n, w: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda local, carry: local + F.coalesce(carry, F.lit(0)),
    )


def row_number() -> Scan:
    return running_sum(F.lit(1).cast("long"))


def running_max(col: Column, inclusive: bool = True) -> Scan:
    upto = 0 if inclusive else -1
    return Scan(
        lambda w, r: F.max(col).over(w.rowsBetween(Window.unboundedPreceding, upto)),
        lambda at: F.max(col),
        lambda n, w: F.max(n).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda local, carry: F.greatest(local, carry),
    )


def previous(col: Column) -> Scan:
    """Value of the row before."""
    return Scan(
        lambda w, r: F.lag(col).over(w),
        lambda at: F.max_by(F.struct(col.alias("v")), at),
        lambda n, w: F.lag(n).over(w)["v"],
        lambda local, carry: F.coalesce(carry, local),
        "first",
    )


def following(col: Column) -> Scan:
    """Value of the row after."""
    return Scan(
        lambda w, r: F.lead(col).over(w),
        lambda at: F.min_by(F.struct(col.alias("v")), at),
        lambda n, w: F.lead(n).over(w)["v"],
        lambda local, carry: F.coalesce(carry, local),
        "last",
    )


def latest(col: Column, inclusive: bool = True) -> Scan:
    """Last value that is not null, up to here."""
    upto = 0 if inclusive else -1
    return Scan(
        lambda w, r: F.last(col, True).over(w.rowsBetween(Window.unboundedPreceding, upto)),
        lambda at: F.max_by(col, F.when(col.isNotNull(), at)),
        lambda n, w: F.last(n, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda local, carry: F.coalesce(local, carry),
    )


def upcoming(col: Column, inclusive: bool = True) -> Scan:
    """First value that is not null, from here on (a running frame over the reversed order)."""
    upto = 0 if inclusive else -1
    return Scan(
        lambda w, r: F.last(col, True).over(r.rowsBetween(Window.unboundedPreceding, upto)),
        lambda at: F.min_by(col, F.when(col.isNotNull(), at)),
        lambda n, w: F.first(n, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        lambda local, carry: F.coalesce(local, carry),
    )


def scan(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    outs: dict[str, Scan],
    keep: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Adds the columns ``outs`` over the rows of each key in order.

    ``keep`` leaves the chunk columns in place, so that a further scan over the same keys and
    order needs no new exchange."""
    keys, order = _names(keys), _names(order)
    laid = _cut_for(df, keys, order)
    df = chunked(df, keys, order, rows)
    if WHOLE in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order)
        r = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        out = df.select("*", *[s.local(w, r).alias(n) for n, s in outs.items()])
        return out if keep else out.drop(WHOLE)
    at = F.struct(*order)
    parts = (
        df.where(F.col(CHUNK) >= 0)
        .groupBy(*keys, CHUNK)
        .agg(*[s.part(at).alias(n) for n, s in outs.items()])
    )
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = parts.select(
        *keys, CHUNK, *[s.carry(n, over).alias(f"_c_{n}") for n, s in outs.items()]
    )
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    r = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order])
    local = (df if laid else by_rows(df, [*keys, CHUNK])).select(
        "*",
        *[s.local(w, r).alias(f"_l_{n}") for n, s in outs.items()],
        *([F.lag(F.lit(1)).over(w).isNull().alias("_edge_first")] if _uses(outs, "first") else []),
        *([F.lead(F.lit(1)).over(w).isNull().alias("_edge_last")] if _uses(outs, "last") else []),
    )
    joined = local.join(F.broadcast(carry), [*keys, CHUNK], "left")
    gates = {"first": F.col("_edge_first"), "last": F.col("_edge_last")}
    values = []
    for n, s in outs.items():
        here, carried = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        both = s.merge(here, carried)
        values.append((F.when(gates[s.edge], both).otherwise(here) if s.edge else both).alias(n))
    out = joined.select(*df.columns, *values)
    return out if keep else out.drop(CHUNK, LAST)


def _uses(outs: dict[str, Scan], edge: str) -> bool:
    return any(s.edge == edge for s in outs.values())


def number_islands(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    starts: Callable[[dict[str, Column]], Column],
    watch: dict[str, Column],
    name: str = "island",
    keep: bool = False,
) -> DataFrame:
    """Numbers runs of rows from 1. A row starts a run when it is the first of its key or
    ``starts`` says so, given the row before as columns named like ``watch``."""
    with_previous = scan(
        df,
        keys,
        order,
        {"_prev": previous(F.struct(*[c.alias(n) for n, c in watch.items()]))},
        keep=True,
    )
    prev = {n: F.col("_prev")[n] for n in watch}
    flag = F.col("_prev").isNull() | F.coalesce(starts(prev), F.lit(False))
    marked = with_previous.withColumn("_start", flag.cast("long")).drop("_prev")
    out = scan(marked, keys, order, {name: running_sum(F.col("_start"))}, keep=keep)
    return out.drop("_start")


def median(df: DataFrame, keys: str | Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key (mean of the two middle values).

    Equal values are counted before any exchange; the middle is found by a running count, so
    no task holds the values of a key. Counts are kept as a checkpoint, as they are read for cut marks, sums and totals."""
    checkpoint_folder(df.sparkSession)
    keys = _names(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")).checkpoint()
    ranked = scan(counts, keys, value, {"_upto": running_sum(F.col("_n"))})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    lo, hi = F.floor((F.col("_all") - 1) / 2) + 1, F.floor(F.col("_all") / 2) + 1
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    return (
        ranked.join(totals, keys)
        .where(holds(lo) | holds(hi))
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(name))
    )
