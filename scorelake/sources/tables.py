"""Parquet tables with a stable row id, and the sequence views over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.ordered import apart, by_rows, cut_columns, relabelled, row_number, scan, tasks_of


def table(spark: SparkSession, folder: str, name: str, rid: bool = False) -> DataFrame:
    """One table. ``rid`` adds a row id from file and position, the same on every attempt."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if rid:
        df = df.withColumn(
            "rid", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        )
    return df


def instant(col: str) -> Column:
    """A zoneless time column read as UTC, whatever the zone of the session."""
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone())


def micros(col: str) -> Column:
    return F.unix_micros(instant(col))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar frame stream: ``vid, event_id, t_us`` (from the first frame)``, value, event_type``."""
    ev = table(spark, folder, "events").select(
        F.col("user_id").alias("vid"), "event_id", micros("ts").alias("us"), "value", "event_type"
    )
    first = ev.groupBy("vid").agg(F.min("us").alias("first_us"))
    return ev.join(first, "vid").select(
        "vid", "event_id", (F.col("us") - F.col("first_us")).alias("t_us"), "value", "event_type"
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vector frame stream: 50 consecutive vectors are one video."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.expr("vec_id div 50").alias("vid"), "embedding", "label"
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with extents ``[x0, x1]`` per frame; pixel columns lie in 0..455."""
    x0 = F.expr("l_partkey % 400")
    return table(spark, folder, "lineitem", rid=True).select(
        F.col("l_orderkey").alias("frame"),
        F.col("l_linenumber").cast("long").alias("line_"),
        F.col("l_partkey").alias("item"),
        x0.alias("x0"),
        (x0 + 5 + F.floor("l_quantity")).alias("x1"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_discount").alias("conf"),
        "rid",
    )


NOTE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Score notes: four to a measure, two to a beat, numbered inside their piece. The cuts
    made for numbering hold for ``(piece, pos)`` too and stay in place for later scans."""
    items = table(spark, folder, "lineitem", rid=True)
    return _as_notes(scan(items, "l_orderkey", [*NOTE_ORDER, "rid"], {"pos": row_number()}, keep=True))


def by_notes(spark: SparkSession, folder: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` gives for the notes of each piece, pieces that were cut apart from the others. The others are dealt by
    piece once: what ``made`` groups or numbers by piece and more needs no further exchange, and no cut marks."""
    items = table(spark, folder, "lineitem", rid=True)
    short, long = apart(items, "l_orderkey", [*NOTE_ORDER, "rid"])
    # rows that tie without the row id are equal in all that notes have
    short = by_rows(short.drop("rid"), "l_orderkey")
    parts = [(short, NOTE_ORDER)] + ([] if long is None else [(long, [*NOTE_ORDER, "rid"])])
    out = [_plain(made(_as_notes(scan(x, "l_orderkey", order, {"pos": row_number()}, keep=True)))) for x, order in parts]
    if long is None:
        return out[0]
    both = out[0].unionByName(out[1])
    return both.withMetadata(both.columns[0], {"tasks": tasks_of(short)})


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*cut_columns(df))


def _as_notes(placed: DataFrame) -> DataFrame:
    return placed.select(
        *relabelled(placed, "piece", "pos"),
        F.col("l_orderkey").alias("piece"),
        F.expr("(pos - 1) div 4 + 1").alias("measure"),
        F.expr("(pos - 1) % 4 div 2 + 1").alias("beat"),
        "pos",
        F.expr("substr('CDEFGAB', cast(1 + l_partkey % 7 as int), 1)").alias("step"),
        F.expr("4 + l_suppkey % 3").alias("octave"),
        F.expr("floor(l_quantity) % 3 - 1").alias("alter_"),
        (F.col("l_returnflag") == "R").alias("tied"),
        F.expr("shiftleft(1L, cast(l_partkey % 6 as int))").alias("duration"),
        F.expr("cast(l_linenumber % 2 as bigint)").alias("dots"),
        F.expr("case when l_suppkey % 4 = 0 then 3L end").alias("tuplet"),
        F.expr("l_partkey % 6").alias("string_"),
        F.expr("l_suppkey % 25").alias("fret"),
        F.col("l_discount").alias("conf"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").cast("long").alias("linenumber"),
        F.expr("floor(l_quantity)").alias("qty"),
    )


FOUND = "partkey % 17 <> 0"
FOUND_AS = {
    "fret": "case when partkey % 13 = 0 then fret + 1 else fret end",
    "string_": "case when partkey % 11 = 0 then string_ + 1 else string_ end",
}


def recognised(df: DataFrame) -> DataFrame:
    """The notes as a recogniser might return them: some missed, some fret or string wrong."""
    return df.where(FOUND).withColumns({k: F.expr(v) for k, v in FOUND_AS.items()})


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Measure numbers with gaps."""
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("piece"), F.col("l_linenumber").cast("long").alias("number"))
        .distinct()
    )


def drum_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Drum noteheads."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("note_id"),
        F.expr("substr('CDEFGAB', cast(1 + p_partkey % 7 as int), 1)").alias("step"),
        F.expr("4 + p_partkey % 2").alias("octave"),
        F.expr(
            "case p_size % 4 when 0 then 'x' when 1 then 'circle-x' when 2 then 'hollow' "
            "else 'normal' end"
        ).alias("notehead"),
        F.expr("p_size % 5 = 0").alias("open_"),
        F.col("p_size").cast("long").alias("size_"),
    )


def systems(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered parts with an attribute each, a key signature on every third."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("piece"),
        F.col("turn").alias("seq"),
        F.col("role").alias("attr"),
        F.expr("case when turn % 3 = 0 then cast(length(text) % 5 - 2 as bigint) end").alias("fifths"),
        F.expr("cast(length(text) as bigint)").alias("chars"),
    )


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edit log."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("piece"),
        F.col("o_orderkey").alias("seq"),
        F.expr("o_custkey % 7").alias("target"),
        F.col("o_orderstatus").alias("op"),
        F.expr("floor(o_totalprice) % 30").alias("value"),
    )
