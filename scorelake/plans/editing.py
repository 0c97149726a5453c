"""Edits in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import edits as ed
from scorelake.operators import mapping as mp
from scorelake.plans.registry import register, sql
from scorelake.plans.score import LEN_SQL
from scorelake.sources import tables as t

c = F.col

# The order log as edits of the first beats of the pieces with small numbers.
LOG_SQL = "ed as (select o_custkey piece, o_orderkey seq, 1 + o_orderkey % 4 pos, 1 + o_orderkey % 2 beat, o_orderkey % 6 string_, o_orderstatus op, cast(floor(o_totalprice) as bigint) % 34 val from orders)"


def log(spark, d):
    return t.table(spark, d, "orders").select(
        c("o_custkey").alias("piece"), c("o_orderkey").alias("seq"), F.expr("1 + o_orderkey % 4").alias("pos"),
        F.expr("1 + o_orderkey % 2").alias("beat"), F.expr("o_orderkey % 6").alias("string_"), c("o_orderstatus").alias("op"),
        F.expr("floor(o_totalprice) % 34").alias("value"),
    )


def renamed(df, **names):
    """``op`` of the log under the names of an operator."""
    out = F.lit(None).cast("string")
    for code, name in names.items():
        out = F.when(c("op") == code, F.lit(name)).otherwise(out)
    return df.withColumn("op", out)


STRINGS_SQL = """st as (select piece, measure, beat, string_, arg_max(fret, pos) fret, bool_or(partkey % 10 = 0) dead, arg_max(tied, pos) and not bool_or(partkey % 10 = 0) tied, arg_max(conf, pos) conf
    from v_notes group by piece, measure, beat, string_)"""


def strings(spark, d):
    return t.notes(spark, d).groupBy("piece", "measure", "beat", "string_").agg(
        F.max_by("fret", "pos").alias("fret"), F.expr("bool_or(partkey % 10 = 0)").alias("dead"),
        F.max_by("tied", "pos").alias("t"), F.max_by("conf", "pos").alias("conf"),
    ).withColumn("tied", c("t") & ~c("dead")).drop("t")


@register(
    "ed1_set_frets",
    sql(
        "v_notes", LOG_SQL, STRINGS_SQL,
        "la as (select piece, 1 measure, beat, string_, arg_max(op, seq) op, arg_max(val, seq) val from ed where not (op = 'O' and val > 30) group by piece, beat, string_)",
        """select piece, measure, beat, string_, case op when 'O' then val when 'P' then 0 else fret end fret, case when op is not null then op = 'P' else dead end dead,
            coalesce(tied, false) and op is distinct from 'P' tied, case when op is not null then 1.0::double else conf end conf
            from (select piece, cast(measure as bigint) measure, beat, string_, op, val from la) l full join st using (piece, measure, beat, string_) where op is distinct from 'F'""",
    ),
)
def _(spark, d):
    e = renamed(log(spark, d), O="set", P="dead", F="clear").withColumn("measure", F.lit(1).cast("long"))
    return ed.set_frets(strings(spark, d), e, ["piece", "measure", "beat", "string_"])


@register(
    "ed2_toggle_ties",
    sql(
        "v_notes", LOG_SQL, STRINGS_SQL,
        "n as (select piece, 1::bigint measure, beat, string_, count(*) n from ed where op = 'F' group by all)",
        """select piece, measure, beat, string_, tied <> (coalesce(n, 0) % 2 = 1 and not dead) tied from st left join n using (piece, measure, beat, string_)""",
    ),
)
def _(spark, d):
    e = log(spark, d).where("op = 'F'").withColumn("measure", F.lit(1).cast("long"))
    key = ["piece", "measure", "beat", "string_"]
    return ed.toggle_ties(strings(spark, d), e, key).select(*key, "tied")


KIND_SQL = "case val % 5 when 0 then 'natural' when 1 then 'artificial' when 2 then 'whistle' when 3 then 'tap' end"


def harmonic_log(spark, d):
    return log(spark, d).withColumn("kind", F.expr(KIND_SQL.replace("val", "value")))


@register(
    "ed3_set_harmonics",
    sql(
        "v_notes", LOG_SQL,
        f"h as (select piece, pos, seq, {KIND_SQL} kind from ed where {KIND_SQL} is distinct from 'whistle')",
        "la as (select piece, pos, arg_max([kind], seq)[1] kind, true hit from h group by all)",
        """select piece, pos, case when hit then kind when partkey % 8 = 0 then 'pinch' end harmonic,
            case when hit then case when kind is not null then coalesce(case when partkey % 8 = 0 then 7 end, case when kind = 'natural' then fret else 12 end) end
            when partkey % 8 = 0 then 7 end harmonic_fret from v_notes left join la using (piece, pos)""",
    ),
)
def _(spark, d):
    good, _bad = ed.harmonic_edits(harmonic_log(spark, d))
    has = F.expr("partkey % 8 = 0")
    n = t.notes(spark, d).select(
        "piece", "pos", "fret", F.when(has, "pinch").alias("harmonic"), F.when(has, F.lit(7).cast("long")).alias("harmonic_fret")
    )
    return ed.set_harmonics(n, good, ["piece", "pos"]).select("piece", "pos", "harmonic", "harmonic_fret")


@register("ed3_rejected_edits", sql("", LOG_SQL, f"select piece, pos, seq, {KIND_SQL} kind from ed where {KIND_SQL} = 'whistle'"))
def _(spark, d):
    return ed.harmonic_edits(harmonic_log(spark, d))[1].select("piece", "pos", "seq", "kind")


# Edits of all techniques, some of them wrong: the kind from the number of the edit, the value from the log's value.
TECH_KIND = "case seq // 8 % 11 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate([r[0] for r in ed.TECHNIQUES] + ["loudness"])) + " end"
TECH_VALUE = """case when kind = 'bend' then case val % 5 when 0 then 'null' when 1 then '0' when 2 then '"full"' else val || '.5' end
    when kind = 'slide' then case val % 6 when 0 then '"shift"' when 1 then '"legato"' when 2 then '"out_down"' when 3 then 'null' when 4 then '"sideways"' else '"out_up"' end
    when kind = 'slide_in' then case val % 4 when 0 then '"below"' when 1 then '"above"' when 2 then 'null' else '3' end
    when kind = 'harmonic' then case val % 5 when 0 then '"natural"' when 1 then '"artificial"' when 2 then 'null' when 3 then '"whistle"' else '"tap"' end
    when kind = 'harmonic_fret' then case val % 5 when 0 then 'null' when 1 then '0' when 2 then '12.5' when 3 then '40' else '"12"' end
    else case val % 6 when 0 then 'true' when 1 then 'false' when 2 then 'null' when 3 then '1' when 4 then '{' else 'true' end end"""
TECH_SQL = [
    LOG_SQL,
    f"tk as (select *, {TECH_VALUE} v from (select *, {TECH_KIND} kind from ed))",
    """ck as (select *, case when kind = 'loudness' then 'unknown technique' when v = '{' then 'not a value' when not coalesce(case when kind = 'bend' then v = 'null' or (try_cast(v as double) > 0 and try_cast(v as double) <= 12)
        when kind = 'harmonic_fret' then v = 'null' or (try_cast(v as double) >= 0 and try_cast(v as double) <= 36) when kind in ('slide', 'slide_in', 'harmonic') then v not in ('"sideways"', '3', '"whistle"')
        else v in ('true', 'false') end, false) then 'invalid value' end reason from tk)""",
]
TECH_NOTES = {
    "bend": "case when partkey % 5 = 0 then 1.5D end", "bend_release": "partkey % 10 = 0", "slide": "case when partkey % 4 = 0 then 'shift' end",
    "slide_in": "case when partkey % 6 = 0 then 'below' end", "hopo": "suppkey % 3 = 0", "harmonic": "case when partkey % 8 = 0 then 'pinch' end",
    "harmonic_fret": "case when partkey % 8 = 0 then 7.0D end", "vibrato": "suppkey % 4 = 0", "palm_mute": "suppkey % 5 = 0", "staccato": "suppkey % 7 = 0",
}
DUCK_NOTES = {k: v.replace("1.5D", "1.5::double").replace("7.0D", "7.0::double") for k, v in TECH_NOTES.items()}


def technique_log(spark, d):
    e = log(spark, d).withColumnRenamed("value", "val").withColumn("kind", F.expr(TECH_KIND.replace("//", "div")))
    return ed.technique_edits(e.withColumn("v", F.expr(TECH_VALUE)), "v")


@register("ed3_technique_rejects", sql("", *TECH_SQL, "select piece, pos, seq, kind, v, reason from ck where reason is not null"))
def _(spark, d):
    return technique_log(spark, d).where("reason is not null").select("piece", "pos", "seq", "kind", "v", "reason")


def _last(kind: str, shown: str) -> str:
    return f"case when k_{kind} is not null then {shown} else o_{kind} end {kind}"


@register(
    "ed3_set_techniques",
    sql(
        "v_notes", *TECH_SQL,
        "gd as (select * from ck where reason is null)",
        "la as (select piece, pos, " + ", ".join(f"arg_max(v, seq) filter (kind = '{k}') k_{k}" for k in TECH_NOTES) + " from gd group by all)",
        "hf as (select piece, pos, list({'seq': seq, 'kind': kind, 'v': v, 'f': null::double} order by seq) filter (kind in ('harmonic', 'harmonic_fret')) l from gd group by all)",
        "nt as (select piece, pos, fret, " + ", ".join(f"{v} o_{k}" for k, v in DUCK_NOTES.items()) + " from v_notes)",
        """fr as (select piece, pos, list_reduce(list_prepend({'seq': 0, 'kind': '', 'v': '', 'f': o_harmonic_fret}, coalesce(l, [])), lambda a, e: {'seq': e.seq, 'kind': e.kind, 'v': e.v, 'f':
            case when e.kind = 'harmonic_fret' then try_cast(e.v as double) when e.v = 'null' then null else coalesce(a.f, case when e.v = '"natural"' then fret::double else 12.0::double end) end}).f harmonic_fret
            from nt left join hf using (piece, pos))""",
        "select piece, pos, fret, fr.harmonic_fret, " + ", ".join(
            _last(k, {"bend": "try_cast(k_bend as double)"}.get(k, f"nullif(trim(k_{k}, '\"'), 'null')" if k in ("slide", "slide_in", "harmonic") else f"k_{k} = 'true'")) for k in TECH_NOTES if k != "harmonic_fret"
        ) + " from nt left join la using (piece, pos) join fr using (piece, pos)",
    ),
)
def _(spark, d):
    n = t.notes(spark, d).select("piece", "pos", "fret", *(F.expr(v).alias(k) for k, v in TECH_NOTES.items()))
    return ed.set_techniques(n, technique_log(spark, d), ["piece", "pos"])


@register(
    "ed4_toggle_beat_marks",
    sql(
        "v_notes", LOG_SQL,
        "n as (select piece, 1::bigint measure, beat, count(*) n from ed where op = 'O' group by all)",
        "al as (select piece, measure, beat, bool_and(linenumber % 2 = 0) al from v_notes group by all)",
        """select piece, pos, case when n is null then linenumber % 2 = 0 when n % 2 = 1 then not al else al end palm_mute
            from v_notes left join n using (piece, measure, beat) left join al using (piece, measure, beat)""",
    ),
)
def _(spark, d):
    e = log(spark, d).where("op = 'O'").withColumn("measure", F.lit(1).cast("long"))
    n = t.notes(spark, d).withColumn("palm_mute", F.expr("linenumber % 2 = 0"))
    return ed.toggle_beats(n, e, ["piece", "measure", "beat"], "palm_mute").select("piece", "pos", "palm_mute")


BEAT_OPS = "case when op = 'O' then 'duration' when op = 'F' then 'dot' when val % 2 = 0 then 'triplet' else 'rest' end"


@register(
    "ed5_change_beats",
    sql(
        "v_notes", LOG_SQL,
        f"""ch as (select piece, pos, arg_max(1 << (val % 6), seq) filter (op = 'O') dd, count(*) filter (op = 'F') kk,
            count(*) filter (op = 'P' and val % 2 = 0) tt, count(*) filter (op = 'P' and val % 2 = 1) rr from ed group by all)""",
        """select piece, pos, cast(coalesce(dd, duration) as bigint) duration, case when coalesce(kk, 0) % 2 = 1 then case when dots > 0 then 0 else 1 end else dots end dots,
            case when coalesce(tt, 0) % 2 = 1 then case when tuplet is null then 3 end else tuplet end tuplet,
            (partkey % 6 = 0) <> (coalesce(rr, 0) % 2 = 1) rest from v_notes left join ch using (piece, pos)""",
    ),
)
def _(spark, d):
    e = log(spark, d).withColumn("op", F.expr(BEAT_OPS.replace("val", "value"))).withColumn(
        "value", F.expr("shiftleft(1L, cast(value % 6 as int))")
    )
    n = t.notes(spark, d).select("piece", "pos", "duration", "dots", "tuplet", F.expr("partkey % 6 = 0").alias("rest"))
    return ed.change_beats(n, e, ["piece", "pos"])


@register(
    "ed6_insert_and_delete",
    sql(
        "v_notes", LOG_SQL,
        "bs as (select piece, measure, pos, duration, partkey % 6 = 0 rest from v_notes)",
        "e1 as (select *, 1::bigint measure from ed)",
        """rows_ as (select piece, measure, pos * 2 a, -1 s, duration, rest from bs where not exists (select 1 from e1 where e1.piece = bs.piece and e1.measure = bs.measure
            and e1.pos = bs.pos and e1.op = 'P') union all select piece, measure, pos * 2 + case when op = 'F' then -1 else 1 end, seq, duration, true from e1 join bs using (piece, measure, pos) where op in ('F', 'O'))""",
        "al as (select * from rows_ union all select piece, measure, 0, -1, 1, true from (select distinct piece, measure from bs) b where not exists (select 1 from rows_ r where r.piece = b.piece and r.measure = b.measure))",
        "select piece, measure, row_number() over (partition by piece, measure order by a, s) number, duration, rest from al",
    ),
)
def _(spark, d):
    e = renamed(log(spark, d), F="before", O="after", P="delete").withColumn("measure", F.lit(1).cast("long"))
    n = t.by_notes(spark, d, lambda n: n.select("piece", "measure", "pos", "duration", F.expr("partkey % 6 = 0").alias("rest")))
    return ed.insert_and_delete(n, e, ["piece", "measure"])


@register(
    "ed7_confirm_beats",
    sql(
        "v_notes", LOG_SQL,
        "h as (select distinct piece, 1::bigint measure, pos, true hit from ed where op = 'O')",
        "j as (select v.*, coalesce(hit, false) hit from v_notes v left join h using (piece, measure, pos))",
        f"s as (select piece, measure, sum({LEN_SQL}) = 80640 full_, bool_or(hit) any_ from j group by all)",
        "select piece, pos, case when hit then 1.0::double else conf end conf, case when any_ and full_ then 1.0::double else 0.3 end measure_conf from j join s using (piece, measure)",
    ),
)
def _(spark, d):
    e = log(spark, d).where("op = 'O'").withColumn("measure", F.lit(1).cast("long"))
    n = t.notes(spark, d).withColumn("measure_conf", F.lit(0.3))
    return ed.confirm(n, e, ["piece", "measure"], F.lit(80640)).select("piece", "pos", "conf", "measure_conf")


KEYS = ["C5:normal", "G5:x", "F4:normal", "A5:x", "C6:x"]


@register(
    "ed8_overrides",
    sql(
        "", LOG_SQL,
        f"e as (select piece, seq, op, {KEYS}[1 + val % 5] key, case seq % 4 when 0 then 38 when 1 then 42 when 2 then 36 else 55 end gm from ed)",
        "rs as (select piece, max(seq) r from e where op = 'P' group by piece)",
        "la as (select piece, key, arg_max(gm, seq) gm from e left join rs using (piece) where op <> 'P' and seq > coalesce(r, -1) group by piece, key)",
        "select piece, key, cast(gm as bigint) gm from la where not (key = 'C5:normal' and gm = 38 or key = 'G5:x' and gm = 42 or key = 'F4:normal' and gm = 36 or key = 'A5:x' and gm = 49)",
    ),
)
def _(spark, d):
    e = renamed(log(spark, d), P="preset", O="choose", F="choose")
    e = e.withColumns({
        "key": F.get(F.array(*[F.lit(k) for k in KEYS]), F.expr("cast(value % 5 as int)")),
        "gm": F.expr("case seq % 4 when 0 then 38L when 1 then 42L when 2 then 36L else 55L end"),
    })
    return ed.overrides_after(e, mp.preset(spark, "default"), ["piece"]).select("piece", "key", "gm")


@register(
    "ed9_without_pages",
    sql("v_notes", LOG_SQL, "select distinct piece, measure from v_notes v where not exists (select 1 from ed where op = 'P' and ed.piece = v.piece and ed.pos = v.measure)"),
)
def _(spark, d):
    e = log(spark, d).where("op = 'P'").select("piece", c("pos").alias("measure"))
    return ed.without_pages(t.notes(spark, d).select("piece", "measure").distinct(), e, ["piece", "measure"])
