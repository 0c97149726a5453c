"""Modes, rates, comparisons and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators.ordered import by_rows, cut_columns

c = F.col


def first_mode(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """Most common value per key; of equally common ones the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_at"))
    ranked = counts.withColumn("_r", F.struct(-c("_n"), c("_at")))
    return ranked.groupBy(*keys).agg(F.min_by(value, "_r").alias(name))


def consistent_groups(df: DataFrame, keys: Sequence[str], group: str, value: str, order: Sequence[str]) -> DataFrame:
    """Groups whose members all have the most common value and whose size is then the most
    common one."""
    mode = first_mode(df, keys, value, order, "_mode")
    groups = (
        df.join(mode, keys)
        .groupBy(*keys, group)
        .agg(F.bool_and(c(value) == c("_mode")).alias("_all"), F.count("*").alias("size"))
        .where("_all")
    )
    size = first_mode(groups, keys, "size", [group], "_size")
    return groups.join(size, keys).where("size = _size").select(*keys, group, "size")


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    """100 a / b, null when b is 0."""
    return F.bround(F.lit(100.0) * a / F.when(b != 0, b), digits)


def filled_numbers(df: DataFrame, piece: str, number: str) -> DataFrame:
    """Measures 1..last: missing ones before the first become rests to trust (confidence 1),
    missing ones between others rests to check (confidence 0). Only when numbers are read,
    start at 1 or later and strictly increase in ``pos`` order; else the piece stays as it is."""
    from scorelake.operators.ordered import previous, scan

    steps = scan(df, piece, "pos", {"_p": previous(c(number))})
    fit = steps.groupBy(piece).agg(
        F.bool_and(
            c(number).isNotNull() & (c(number) >= 1) & F.coalesce(c(number) > c("_p"), F.lit(True))
        ).alias("_fit"),
    ).where("_fit").select(piece)
    gaps = steps.join(fit, piece, "left_semi").select(
        piece,
        F.when(c("_p").isNull(), 1.0).otherwise(0.0).alias("confidence"),
        F.explode(
            F.when(
                c(number) - 1 > F.coalesce("_p", F.lit(0)),
                F.sequence(F.coalesce("_p", F.lit(0)) + 1, c(number) - 1),
            ).otherwise(F.array().cast("array<bigint>"))
        ).alias(number),
    ).withColumn("rest", F.lit(True))
    own = df.select(piece, F.lit(1.0).alias("confidence"), number, F.lit(False).alias("rest"))
    return own.unionByName(gaps)


def best_shift(a: Column, b: Column, width: int, least: int, overlap: int, near: int, margin: float) -> tuple[Column, Column]:
    """Scores per shift as ``(shift, score)`` rows, and the answer from such an array: overlap
    over union of two 0/1 vectors per shift, the first best one; score 0 when another shift
    more than ``near`` away comes within ``margin``."""

    def score(s: Column) -> Column:
        x = F.slice(a, s + 1, F.lit(width) - s)
        y = F.slice(b, F.lit(1), F.lit(width) - s)
        both = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p & q)), lambda v: v))
        either = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p | q)), lambda v: v))
        return F.struct(
            s.alias("shift"), F.when(either > 0, both / either).otherwise(0.0).alias("score")
        )

    scores = F.transform(F.sequence(F.lit(least), F.lit(width - overlap)), score)
    rows = c("_scores")
    top = F.array_min(F.transform(rows, lambda r: F.struct((-r["score"]).alias("n"), r["shift"].alias("shift"))))
    far = F.array_max(
        F.transform(F.filter(rows, lambda r: F.abs(r["shift"] - c("_top.shift")) > near), lambda r: r["score"])
    )
    best = -c("_top.n")
    answer = F.struct(
        c("_top.shift").alias("shift"),
        F.when(far.isNotNull() & (best - far < margin), 0.0).otherwise(best).alias("score"),
    )
    return scores, top, answer


def with_best_shift(df: DataFrame, a: Column, b: Column, **size) -> DataFrame:
    scores, top, answer = best_shift(a, b, **size)
    return df.withColumn("_scores", scores).withColumn("_top", top).withColumn("_a", answer).select(
        *df.columns, c("_a.shift").alias("shift"), c("_a.score").alias("score")
    )


def laplacian_variance(values: Column, size: int) -> Column:
    """Sharpness: variance of the second differences of a vector."""
    second = F.transform(
        F.sequence(F.lit(1), F.lit(size - 2)),
        lambda i: F.get(values, i - 1) + F.get(values, i + 1) - 2 * F.get(values, i),
    )
    return second


def mean_variance(xs: Column) -> Column:
    """Population variance of whole numbers in an array, by their sums."""
    n = F.size(xs)
    s = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return (q * n - s * s) / (n * n)


def keyed(df: DataFrame, key: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """One row per note key with its flags (a key seen twice counts once)."""
    return df.groupBy(*key).agg(*[F.bool_or(f).alias(n) for n, f in flags.items()])


def matched(truth: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer match of note keys: ``g``, ``r`` tell which side has it."""
    g = truth.withColumn("g", F.lit(True)).withColumnsRenamed({n: f"g_{n}" for n in truth.columns if n not in key})
    r = found.withColumn("r", F.lit(True)).withColumnsRenamed({n: f"r_{n}" for n in found.columns if n not in key})
    return g.join(r, [*key], "full_outer").withColumns(
        {"g": F.coalesce("g", F.lit(False)), "r": F.coalesce("r", F.lit(False))}
    )


def exact_groups(rows: DataFrame, group: Sequence[str], item: Sequence[str], truth: Column, found: Column) -> DataFrame:
    """(group, e): whether the items of truth and those found are the same set. ``rows`` hold both sides, each row with
    the struct of ``item`` as ``truth`` and as ``found``, null where a side lacks it: so rows are read once and nothing
    is joined. An item with a null is equal to none."""
    side = lambda s, g: F.when(s.isNotNull(), F.struct(s.alias("i"), F.lit(g).alias("g")))
    both = rows.select(*cut_columns(rows), *group, F.explode(F.array_compact(F.array(side(truth, True), side(found, False)))).alias("x"))
    both = by_rows(both, group).select(*group, *(c("x.i")[n].alias(n) for n in item), c("x.g").alias("_g"))
    known = F.lit(True)
    for n in item:
        known = known & c(n).isNotNull()
    items = both.groupBy(*group, *item).agg((F.bool_or("_g") & F.bool_or(~c("_g"))).alias("_both"))
    return items.groupBy(*group).agg(F.bool_and(c("_both") & known).alias("e"))


def multiset_intersection(a: DataFrame, b: DataFrame, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Size of the multiset intersection of two row sets per group."""
    x = a.groupBy(*group, *item).agg(F.count("*").alias("_a"))
    y = b.groupBy(*group, *item).agg(F.count("*").alias("_b"))
    return x.join(y, [*group, *item]).groupBy(*group).agg(F.sum(F.least("_a", "_b")).alias("common"))


def duration_error(g: Column, r: Column) -> Column:
    """Class of a wrong duration; ``g`` and ``r`` have duration, dots and tuplet."""
    a, b = g["duration"], r["duration"]
    either = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (
        F.when(~g["tuplet"].eqNullSafe(r["tuplet"]), F.lit("tuplet"))
        .when((g["dots"] != r["dots"]) & (a == b), F.lit("dot"))
        .when(either(2, 4), F.lit("half/quarter"))
        .when(either(1, 2), F.lit("whole/half"))
        .when(a != b, F.concat(F.lit("value "), a.cast("string"), F.lit("->"), b.cast("string")))
        .otherwise(F.lit("other"))
    )


def numbering(df: DataFrame, keys: Sequence[str], measure: str, place: str, read: str, final: str) -> DataFrame:
    """How read and final numbers agree with each other and with the sequence that starts at the first measure.

    A number is in sequence where it is as far from its place as the first measure is from place 1; these differences
    are counted by value before they meet the first measure."""
    one = df.groupBy(*keys).agg(
        F.min(measure).alias("_first"), F.count("*").alias("measures"), F.count(read).alias("ocr_read"),
        F.count_if(F.col(read) == F.col(final)).alias("agrees"),
        (F.count(final) - F.count_distinct(final)).alias("duplicates"),
    )
    kind = lambda k, name: F.struct(F.lit(k).alias("kind"), (F.col(name) - F.col(place) + 1).alias("start"))
    starts = df.select(*keys, F.inline(F.array(kind("f", final), kind("r", read)))).groupBy(*keys, "kind", "start").agg(F.count("*").alias("k"))
    both = one.join(starts, [*keys], "left")
    right = lambda k: F.coalesce(F.sum(F.when((F.col("start") == F.col("_first")) & (F.col("kind") == k), F.col("k"))), F.lit(0).cast("long"))
    told = ["measures", "ocr_read", "agrees", "duplicates"]
    return both.groupBy(*keys, *told).agg(right("f").alias("in_sequence"), right("r").alias("read_in_sequence"))


# Techniques whose value is compared too.
VALUED = ("bend", "slide", "slide_in", "harmonic")


def technique_value(side: str, kind: str) -> Column:
    """What a note of the ``g`` or ``r`` side has of a technique, as text; null where it has none. A bend goes with its
    release."""
    v = c(f"{side}_{kind}")
    if kind == "bend":
        return F.when(v.isNotNull(), F.concat_ws("/", v.cast("double").cast("string"), F.coalesce(f"{side}_bend_release", F.lit(False)).cast("string")))
    return F.when(v, "true") if kind not in VALUED else F.nullif(v, F.lit(""))


def technique_counts(pairs: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(keys, technique, gt, rec, hit, value_ok) over notes found on both sides, ``g_`` and ``r_`` columns of each: how
    many are marked in truth, in what was found, on both sides, and with the same value (null where a mark has none).

    All kinds are counted in one pass, and the few counts are turned into rows after that."""
    counts = []
    for k in kinds:
        g, r = technique_value("g", k), technique_value("r", k)
        both = g.isNotNull() & r.isNotNull()
        counts += [F.count(g).alias(f"{k}_gt"), F.count(r).alias(f"{k}_rec"), F.count_if(both).alias(f"{k}_hit"), F.count_if(F.coalesce(g == r, F.lit(False))).alias(f"{k}_ok")]
    rows = F.array(*[
        F.struct(F.lit(k).alias("technique"), *[c(f"{k}_{n}").alias(n) for n in ("gt", "rec", "hit")], (c(f"{k}_ok") if k in VALUED else F.lit(None).cast("long")).alias("value_ok"))
        for k in kinds
    ])
    return pairs.groupBy(*keys).agg(*counts).select(*keys, F.inline(rows))


def beat_rates(truth: DataFrame, found: DataFrame, piece: Sequence[str], room: Column) -> DataFrame:
    """Per piece: how many measures are found and sum up to ``room``, how many beats have the right notes (``grouped``)
    and, of those, the right rhythm (``timed``), with rates in percent; null rates where there is nothing to count.

    Both sides have a row per beat: (piece, measure, beat, notes, rest, duration, dots, tuplet), ``notes`` a sorted set;
    beats are matched by number."""
    piece = list(piece)
    measure = [*piece, "measure"]
    fields = ("notes", "rest", "duration", "dots", "tuplet")
    r = found.select(*measure, "beat", F.struct(*fields).alias("r"))
    both = truth.select(*measure, "beat", F.struct(*fields).alias("g")).join(r, [*measure, "beat"], "left")
    grouped = F.coalesce((c("g.notes") == c("r.notes")) & (c("g.rest") == c("r.rest")), F.lit(False))
    timed = grouped & (c("g.duration") == c("r.duration")) & (c("g.dots") == c("r.dots")) & c("g.tuplet").eqNullSafe(c("r.tuplet"))
    beats = both.groupBy(*piece).agg(F.count("*").alias("beats"), F.count_if(grouped).alias("grouped"), F.count_if(timed).alias("timed"))
    sums = found.groupBy(*measure).agg((F.sum(tk.length(c("duration"), c("dots"), c("tuplet"))) == F.first(room)).alias("ok"))
    sums = truth.select(*measure).distinct().join(sums, measure, "left").groupBy(*piece).agg(F.count("*").alias("measures"), F.count("ok").alias("found"), F.count_if("ok").alias("sum_ok"))
    return sums.join(beats, piece).select(
        *piece, "measures", "found", "sum_ok", "beats", "grouped", "timed", percent(c("found"), c("measures")).alias("measure_alignment"),
        percent(c("grouped"), c("beats")).alias("beat_grouping"), percent(c("timed"), c("grouped")).alias("duration_on_grouped"), percent(c("sum_ok"), c("found")).alias("measures_summing"),
    )
