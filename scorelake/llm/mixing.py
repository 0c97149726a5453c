"""Mixing sources to target weights by whole documents: a bounded knapsack over counts of exact lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from scorelake.llm.common import WORD, written

#: Words that the dynamic programme settles; what is above is filled in proportion and by the longest.
RESERVE = 1 << 16
#: Rows of a (source, length) group that are ranked together; larger groups are split by the hash of the id.
RANKED = 2000
#: (source, length) pairs that are broadcast at most to the texts, about 20 MB.
BROADCAST_PAIRS = 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Adds _target: shares by weight of ``share`` times all words, cut at ``limit`` times a source's own, the excess
    reshared until none is above. That is the level at which the cut shares add up; it is found over the sources
    (a row each) in order of the level at which each is cut. Sources by code point, null last."""
    by_name = Window.orderBy(F.col("_src").isNull(), "_src")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", F.lit(limit) * F.col("_source_size"))
    x = x.withColumn("_at", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_at", F.col("_src").isNull(), "_src")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("_source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(above)
    x = x.withColumn("_level", level)
    level = F.first(F.when(F.col("_level") <= F.col("_at"), F.col("_level")), ignorenulls=True).over(everything)
    return x.withColumn("_target", F.least("_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))).drop("_w", "_cap", "_at", "_level")


def subset(lengths: np.ndarray, stock: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many of each length to take, at most ``stock``, for a sum of ``budget`` or as little less as possible.

    Beyond ``reserve`` words, every length first gives its share in proportion and the longest fill up; a
    bounded knapsack over the rest (a bit set of reachable sums) settles them, exactly where the stock allows."""
    total = int((lengths * stock).sum())
    if budget >= total:
        return stock.copy()
    take = stock * budget // max(total, 1) if budget > reserve else np.zeros_like(stock)
    left = budget - int((take * lengths).sum())
    order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0]
    for i in order:
        more = min(int(stock[i] - take[i]), max(0, left - reserve) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        free, part = min(int(stock[i] - take[i]), left // int(lengths[i])), 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= reach << part * int(lengths[i]) & mask
            free -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _fit(limit: float, reserve: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        lengths, stock = rows["_size"].to_numpy(np.int64), rows["_rows"].to_numpy(np.int64)
        size, target = int(rows["_source_size"].iloc[0]), float(rows["_target"].iloc[0])
        whole = int(min(limit, target // size)) if size else 0
        rest = int(round(target)) - whole * size
        take = subset(lengths, stock, rest, reserve) if whole < limit and rest > 0 else np.zeros_like(stock)
        return rows.assign(_whole=whole, _take=take)[["_src", "_size", "_rows", "_source_size", "_target", "_whole", "_take"]]

    return fit


def mix_table(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 11, id: str = "doc_id", text: str = "text", source: str = "source", reserve: int = RESERVE) -> DataFrame:
    """One row per (source, length in words): how often its documents are taken, (_src, _size, _source_size, _target,
    _whole, _upto). All are taken ``_whole`` times, and those whose seeded hash is at most ``_upto`` once more.

    Only (source, length) counts reach the knapsack: per source at most one row per length, whatever the number of
    documents. The chosen number is marked off by hash order; groups of a length are ranked in parts of about
    ``RANKED`` rows, whose counts are summed up, so that no task holds a hot group."""
    rows = written(docs.select(F.col(id).alias("_id"), F.col(source).alias("_src"), words(text).alias("_size")), "sizes")
    lengths = rows.groupBy("_src", "_size").agg(F.count("*").alias("_rows"))
    sizes = targets(lengths.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_rows")).alias("_source_size")), weights, share, limit)
    known = lengths.join(sizes, lengths["_src"].eqNullSafe(sizes["_src"])).drop(sizes["_src"])
    kinds = "_src string, _size long, _rows long, _source_size long, _target double, _whole long, _take long"
    fits = written(known.groupBy("_src").applyInPandas(_fit(limit, reserve), kinds), "fits")
    part = fits.where("_take > 0 and _take < _rows").select(F.col("_src").alias("_s"), F.col("_size").alias("_n"), "_take", F.ceil(F.col("_rows") / RANKED).alias("_parts"))
    same = F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    ranked = rows.join(part, same).select("_s", "_n", "_take", taken_order(seed, "_id").alias("_u"), "_parts")
    # the hash's highest part first: parts are in hash order, and so are the rows within
    ranked = ranked.withColumn("_part", F.floor((F.col("_u").cast("double") / F.lit(2.0**64) + 0.5) * F.col("_parts")))
    counts = ranked.groupBy("_s", "_n", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_s", "_n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    counts = counts.select(F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("_part").alias("_p2"), "_before", "_c")
    here = F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")) & (F.col("_part") == F.col("_p2"))
    edge = ranked.join(counts, here).where("_before < _take and _take <= _before + _c")
    nth = F.row_number().over(Window.partitionBy("_s", "_n").orderBy("_u"))
    edge = edge.withColumn("_nth", nth).where("_nth = _take - _before").select("_s", "_n", F.col("_u").alias("_upto"))
    low, high = -(2**63), 2**63 - 1
    out = fits.join(edge, same, "left")
    upto = F.when(F.col("_take") == 0, F.lit(None)).when(F.col("_take") == F.col("_rows"), F.lit(high)).otherwise(F.coalesce("_upto", F.lit(low)))
    return written(out.select("_src", "_size", "_source_size", "_target", "_whole", upto.cast("long").alias("_upto")), "mix")


def words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def taken_order(seed: int, id: str):
    return F.xxhash64(F.lit(seed), F.col(id))


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 11, id: str = "doc_id", text: str = "text", source: str = "source", reserve: int = RESERVE, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``docs`` with size, source_size, target and times (how often the mix takes the row, 0 to ``limit``).

    Null texts have size 0; null sources are one source, last in order. Rows that share an id are taken alike.
    The same input, weights and seed give the same mix, in any order and on any number of machines. The table of
    decisions is broadcast to the texts if it has at most ``broadcast_pairs`` rows and joined by a shuffle else."""
    docs = docs.drop("size", "source_size", "target", "times")
    table = mix_table(docs, weights, share, limit, seed, id, text, source, reserve).withColumnsRenamed({"_src": "_s", "_size": "_n"})
    small = table.count() <= broadcast_pairs
    out = docs.withColumn("size", words(text)).join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    times = F.col("_whole") + F.coalesce(taken_order(seed, id) <= F.col("_upto"), F.lit(False)).cast("long")
    return out.select(*docs.columns, "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), times.alias("times"))


def repeated(mix: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    return mix.where("times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_i", "size", "source_size", "target", "times")
