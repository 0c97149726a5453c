"""Alignments, voices, classifiers and guarded maps."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators import alignment, glyphs, timing, voices
from scorelake.plans.registry import register, sql
from scorelake.plans.score import options_of
from scorelake.sources import tables as t

c = F.col


@register("ev1_beat_alignment")
def _(spark, d):
    n = t.notes(spark, d).withColumn("rest", F.expr("partkey % 6 = 0"))
    return alignment.align_beats(n, t.recognised(n), ["piece", "measure"])


def _measures_sql(view: str, x: str) -> str:
    return f"""c{x} as (select piece, dense_rank() over (partition by piece order by measure) - 1 i, string_ s, count(*) c from {view} group by piece, measure, string_),
        z{x} as (select piece, i, sum(c) z from c{x} group by all)"""


@register(
    "ev2_measure_alignment",
    sql(
        "v_notes v_rec",
        _measures_sql("v_notes", "g"), _measures_sql("v_rec", "r"),
        "likes as (select a.piece, a.i, b.i j, sum(least(a.c, b.c)) / greatest(any_value(x.z), any_value(y.z))::double v from cg a join cr b on b.piece = a.piece and b.s = a.s join zg x on x.piece = a.piece and x.i = a.i join zr y on y.piece = b.piece and y.i = b.i group by all)",
        "sizes as (select piece, count(*) n, any_value(coalesce(m, 0)) m from zg left join (select piece, count(*) m from zr group by piece) using (piece) group by piece)",
        """dp as (select piece, 0 k, n, m, [0.0::double] s, [0] mv from sizes
            union all select piece, k + 1, n, m, list_append(s, v), list_append(mv, case when i = 0 then 2 when j = 0 then 1 when a >= b and a >= e then 1 when b >= e then 2 else 3 end)
            from (select x.*, (k + 1) // (m + 1) i, (k + 1) % (m + 1) j, s[k + 1 - m] - 0.3::double a, s[k + 1] - 0.3::double b, s[k - m] + coalesce(l.v, 0.0) e,
                case when (k + 1) // (m + 1) = 0 then s[k + 1] - 0.3::double when (k + 1) % (m + 1) = 0 then s[k + 1 - m] - 0.3::double else greatest(s[k + 1 - m] - 0.3::double, s[k + 1] - 0.3::double, s[k - m] + coalesce(l.v, 0.0)) end v
                from dp x left join likes l on l.piece = x.piece and l.i = (k + 1) // (m + 1) - 1 and l.j = (k + 1) % (m + 1) - 1 where k + 1 < (n + 1) * (m + 1)))""",
        """tr as (select piece, m, mv, n i, m j, 0 way from dp where k + 1 = (n + 1) * (m + 1)
            union all select piece, m, mv, case when w in (1, 3) then i - 1 else i end, case when w in (2, 3) then j - 1 else j end, w from (select *, mv[i * (m + 1) + j + 1] w from tr where i > 0 or j > 0))""",
        "select piece, case when way in (1, 3) then i end g, case when way in (2, 3) then j end r from tr where way > 0",
    ).replace("with ", "with recursive ", 1),
)
def _(spark, d):
    n = t.notes(spark, d)

    def measures(df):
        rows = df.groupBy("piece", "measure").agg(F.collect_list(c("string_").cast("string")).alias("items"))
        from scorelake.operators.ordered import row_number, scan

        return scan(rows, "piece", "measure", {"n": row_number()}).select("piece", (c("n") - 1).alias("i"), "items")

    return alignment.align_measures(measures(n), measures(t.recognised(n)), "piece")


@register("udf5_two_voice_timing")
def _(spark, d):
    return t.by_notes(spark, d, lambda notes: _two_voices(options_of(notes)))


def _two_voices(o):
    liked = timing.dotted_rest_preference(c("options"), c("rest_kind"), c("dot"))
    events = o.select(
        "piece", "measure", "pos", F.expr("1 + pos % 2").alias("voice"),
        F.expr("(pos - 1) % 4 div 2 * 200 + beams * 4").alias("x"), c("rest_kind").isNotNull().alias("rest"),
        (c("rest_kind").isNotNull() & c("dot")).alias("dotted_rest"), liked.alias("options"),
        F.lit(tk.TICKS).cast("long").alias("room"),
    )
    return voices.timed_voices(events, ["piece", "measure"], "room", 480)


@register("udf6_batch_classification")
def _(spark, d):
    v = t.vectors(spark, d)
    classify = glyphs.scorer(glyphs.class_weights(v, "embedding", "label", 64))
    return v.select("vec_id", classify("embedding").alias("k")).select(
        "vec_id", "k.label", F.round("k.p", 6).alias("p")
    )


@register("udf7_train_and_confusions")
def _(spark, d):
    v = t.vectors(spark, d).select("vec_id", "embedding", "label")
    return glyphs.confusion_report(glyphs.trained(v, "embedding", "label", 16, 30), "label")


def _number_of(doc: str) -> int:
    return json.loads(doc)["k"] + 0


@register(
    "udf8_guarded_map",
    sql("", """with raw as (select event_id, case event_id % 5 when 1 then '{"k": "x"}' when 2 then '{}' when 3 then '{"k"' else props end doc from events)
        select event_id, case when event_id % 5 in (0, 4) then cast(doc ->> '$.k' as bigint) end result, event_id % 5 in (0, 4) ok,
        case event_id % 5 when 1 then 'TypeError' when 2 then 'KeyError' when 3 then 'JSONDecodeError' end error, 1::bigint attempts from raw""".replace(
            "cast(doc ->> '$.k' as bigint)", "cast(regexp_extract(doc, '[0-9]+') as bigint)")),
)
def _(spark, d):
    raw = F.expr("""case event_id % 5 when 1 then '{"k": "x"}' when 2 then '{}' when 3 then '{"k"' else props end""")
    rows = t.table(spark, d, "events").select("event_id", raw.alias("doc"), F.lit(0).cast("long").alias("attempts"))
    return glyphs.guarded(rows, "doc", _number_of, "attempts").select("event_id", "result", "ok", "error", "attempts")
