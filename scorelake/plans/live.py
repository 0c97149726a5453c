"""Tracking and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators import tracking
from scorelake.operators.fold import fold
from scorelake.plans.registry import register, sql
from scorelake.plans.score import LEN_SQL, length_of
from scorelake.sources import tables as t
from scorelake.streaming import streams as st

c = F.col
UNIT_MS = 6 * 3_600_000
TRACK = "first_t bigint, last_t bigint, y bigint, best_item bigint, hits bigint"
SEEN = ["t", "y", "item", "sig", "sharp"]


def detections(events: DataFrame) -> DataFrame:
    """Events as detections of six-hour frames with a signature and a sharpness."""
    ms = F.unix_millis(t.instant("ts"))
    kind = F.expr("ascii(event_type) % 5")
    sig = F.shiftleft(F.lit(0x0F0F0F).cast("long"), 1).bitwiseXOR(
        F.call_function("shiftleft", F.lit(0xFFFF).cast("long"), (kind * 10).cast("int"))
    ).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(floor(value) % 63 as int)")))
    return events.select(
        c("user_id").alias("vid"), F.floor(ms / UNIT_MS).alias("t"), F.floor("value").alias("y"),
        c("event_id").alias("item"), sig.alias("sig"), F.expr("event_id % 97").alias("sharp"),
        t.instant("ts").alias("ts"),
    )


def live_rows(spark, d: str, view) -> st.Ending:
    """The events of the table as a stream, with a delay by which no file is late."""
    path = f"{d}/events.parquet"
    delay = st.disorder_ms(spark.read.parquet(path).withColumn("ts", t.instant("ts")), "ts")
    return st.with_end(view(st.table_stream(spark, path)), "ts", delay)


@register("str1_tracks")
def _(spark, d):
    seen = detections(t.table(spark, d, "events"))
    return fold(seen, ["vid"], ["t", "y", "item"], SEEN, tracking.Tracker, TRACK)


@register("str1_tracks_stream")
def _(spark, d):
    seen = live_rows(spark, d, detections)
    return st.run_to_table(st.stream_fold(seen, "vid", UNIT_MS, SEEN, tracking.Tracker, TRACK), seen)


@register("str2_moving_tracks")
def _(spark, d):
    seen = detections(t.table(spark, d, "events"))
    return fold(seen, ["vid"], ["t", "y", "item"], SEEN, tracking.MovingTracker, TRACK)


@register("str2_moving_tracks_stream")
def _(spark, d):
    seen = live_rows(spark, d, detections)
    return st.run_to_table(st.stream_fold(seen, "vid", UNIT_MS, SEEN, tracking.MovingTracker, TRACK), seen)


RUN = "a bigint, z bigint, n bigint"
SEGMENTS = sql(
    "",
    "s as (select user_id vid, epoch_us(ts) // 1000 t, value, event_id from events)",
    "j as (select *, case when abs(value - lag(value) over (partition by vid order by t, event_id)) < 40 then 0 else 1 end j from s)",
    "r as (select *, sum(j) over (partition by vid order by t, event_id) g from j)",
    "select vid, min(t) a, max(t) + 1 z, count(*) n from r group by vid, g having max(t) + 1 - min(t) >= 2",
)


def samples(events: DataFrame) -> DataFrame:
    ms = F.unix_millis(t.instant("ts"))
    return events.select(
        c("user_id").alias("vid"), ms.alias("t"), "value", "event_id", t.instant("ts").alias("ts")
    )


@register("str3_segments", SEGMENTS)
def _(spark, d):
    return fold(samples(t.table(spark, d, "events")), ["vid"], ["t", "event_id"], ["t", "event_id", "value"], tracking.Segmenter, RUN)


@register("str3_segments_stream", SEGMENTS)
def _(spark, d):
    rows = live_rows(spark, d, samples)
    return st.run_to_table(st.stream_fold(rows, "vid", 1, ["t", "event_id", "value"], tracking.Segmenter, RUN), rows)


@register(
    "str4_sampled_stream",
    sql("", """select user_id vid, event_id from events qualify row_number() over (partition by user_id, epoch_us(ts) // 43200000000 order by ts, event_id) = 1"""),
)
def _(spark, d):
    rows = live_rows(spark, d, samples)
    return st.run_to_table(st.stream_sample(rows, ["vid"], "12 hours", ["ts", "event_id"]), rows).select("vid", "event_id")


@register(
    "str5_tumbling_cells",
    sql("", "select user_id vid, cast(epoch_us(ts) // 86400000000 as bigint) day_, count(*) n from events group by all"),
)
def _(spark, d):
    rows = samples(t.table(spark, d, "events"))
    return st.tumbling(rows, ["vid"], "ts", "1 day").select(
        "vid", F.expr("unix_micros(start) div 86400000000").alias("day_"), "n"
    )


@register(
    "str6_sessions",
    sql(
        "",
        "g as (select user_id vid, epoch_us(ts) u, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 36000000000 then 0 else 1 end j from events window w as (partition by user_id order by ts))",
        "s as (select *, sum(j) over (partition by vid order by u) k from g)",
        "select vid, min(u) start_us, max(u) last_us, count(*) n from s group by vid, k",
    ),
)
def _(spark, d):
    out = st.sessions(samples(t.table(spark, d, "events")), ["vid"], "ts", "10 hours")
    return out.select("vid", F.unix_micros("start").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@register(
    "str8_recomputed_changes",
    sql(
        "v_notes",
        "ch as (select distinct o_custkey piece from orders where o_orderstatus = 'P')",
        f"fl as (select piece, measure, cast(sum({LEN_SQL}) as bigint) used from v_notes group by piece, measure)",
        "select piece, measure, used, case when piece in (select piece from ch) then 60480 else 80640 end cap from fl",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    n = n.select("piece", "measure", length_of(n).alias("len"))

    def render(cap):
        return lambda rows: rows.groupBy("piece", "measure").agg(F.sum("len").alias("used")).withColumn("cap", F.lit(cap))

    changed = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("piece"))
    return st.rerendered(render(tk.TICKS)(n), n, changed, ["piece"], render(tk.TICKS * 3 // 4))
