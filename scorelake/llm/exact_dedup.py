"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.llm.common import ascii_lower, written

#: Surviving (length, head) pairs that are broadcast at most, about 40 MB; beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 500_000


def content_hash(text: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)


def copy_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = 256, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per text that more than one row has: (_sha, _keep, _size, _repeats).

    The first pass keeps a length and a hash of the first ``head`` characters per row, a few bytes. Lengths that
    occur once go first, then (length, head) pairs that occur once; only rows of the pairs that are left are read
    and hashed in full. No text is shuffled. All counts are combined on the map side, so a group of any size ends
    as one row per task. ``_repeats``: how many rows have the id that stays.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), whole.alias("_text"))
    n, first = F.octet_length("_text").alias("_n"), F.xxhash64(ascii_lower(F.substring("_text", 1, head))).alias("_head")
    narrow = written(rows.select(n, first), "heads")
    lengths = narrow.groupBy("_n").count().where("count > 1").select("_n")
    pairs = narrow.join(lengths, "_n", "left_semi").groupBy("_n", "_head").count().where("count > 1").select("_n", "_head")
    pairs = written(pairs, "pairs")
    sha = F.sha2(ascii_lower(F.col("_text")), 256).alias("_sha")
    if pairs.count() <= broadcast_pairs:
        left = rows.select("_id", "_text", n, first).join(F.broadcast(pairs), ["_n", "_head"], "left_semi").select("_id", sha)
    else:  # hash before the exchange, so that hashes travel and not texts
        left = rows.select("_id", sha, n, first).join(pairs, ["_n", "_head"], "left_semi").select("_id", "_sha")
    by_id = left.groupBy("_sha", "_id").agg(F.count("*").alias("_c"))
    groups = by_id.groupBy("_sha").agg(F.max(F.struct("_id", "_c")).alias("_top"), F.sum("_c").alias("_size"))
    return groups.where("_size > 1").select("_sha", F.col("_top._id").alias("_keep"), "_size", F.col("_top._c").alias("_repeats"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = 256, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; columns of these names are replaced.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; null ids are least. If several rows have that id and text, just one of them stays. A table
    without rows gives none. The join back is a left join on the hash, whose hot keys adaptive execution splits.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    groups = written(copy_groups(docs, id, text, head, broadcast_pairs), "groups")
    out = docs.withColumn("_sha", content_hash(text)).join(groups, "_sha", "left")
    out = out.withColumn("kept", F.col("_size").isNull() | F.col(id).eqNullSafe(F.col("_keep")))
    if not groups.where("_repeats > 1").isEmpty():
        twin = F.col("kept") & (F.coalesce("_repeats", F.lit(1)) > 1)
        twins = written(out.where(twin).withColumn("_row", F.monotonically_increasing_id()), "twins")
        one = twins.groupBy("_sha").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_one"))
        twins = twins.join(one, "_row", "left").withColumn("kept", F.coalesce("_one", F.lit(False))).drop("_row", "_one")
        out = out.where(~twin).unionByName(twins)
    keep = F.when(F.col("_size").isNull(), F.col(id)).otherwise(F.col("_keep"))
    return out.select(*docs.columns, keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), "kept", F.col("_sha").alias("text_sha256"))
