"""Lengths, readings, solving, placing and short texts over the score notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions import boxes as bx
from scorelake.functions import music as mu
from scorelake.functions import ticks as tk
from scorelake.operators import timing
from scorelake.operators.ordered import latest, scan
from scorelake.plans.registry import register, sql
from scorelake.sources import tables as t

c = F.col
LEN_SQL = """((80640 * ((2 << dots) - 1) * coalesce(case tuplet when 3 then 2 when 5 then 4 when 6 then 4
    when 7 then 4 when 9 then 8 else tuplet end, 1)) // (duration * (1 << dots) * coalesce(tuplet, 1)))"""
PLAIN_SQL = """plain as (select cast(1 << i as bigint) d, cast(k as bigint) k,
    cast((80640 * ((2 << k) - 1)) // ((1 << i) * (1 << k)) as bigint) v
    from (select unnest(range(0, 7)) i), (select unnest(range(0, 3)) k))"""


def length_of(n):
    return tk.length(c("duration"), c("dots"), c("tuplet"))


@register("prj7_dotted_length", sql("v_notes", f"select piece, pos, cast({LEN_SQL} as bigint) len from v_notes"))
def _(spark, d):
    n = t.notes(spark, d)
    return n.select("piece", "pos", length_of(n).alias("len"))


@register(
    "prj8_spell_length",
    sql(
        "v_notes",
        PLAIN_SQL,
        f"rooms as (select piece, pos, cast({LEN_SQL} as bigint) * (1 + fret % 3) room from v_notes)",
        """select r.piece, r.pos, room, s.d value_, s.k dots, coalesce(f.d, 64) fit_value, coalesce(f.k, 0) fit_dots
           from rooms r left join plain s on s.v = room
           asof left join (select * from plain where k < 2) f on f.v <= room""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    rooms = n.select("piece", "pos", (length_of(n) * F.expr("1 + fret % 3")).alias("room"))
    return rooms.select("piece", "pos", "room", tk.spell(c("room")).alias("s"), tk.largest_fitting(c("room")).alias("f")).select(
        "piece", "pos", "room", c("s.value").alias("value_"), c("s.dots").alias("dots"),
        c("f.value").alias("fit_value"), c("f.dots").alias("fit_dots"),
    )


@register(
    "prj9_needs_review",
    sql(
        "v_notes",
        """select piece, measure, beat, bool_or(conf * 10 < 0.7) or min(qty) < 3 or bool_or(partkey % 19 = 0) flagged
           from v_notes group by piece, measure, beat""",
    ),
)
def _(spark, d):
    from scorelake.operators.review import needs_review

    n = t.notes(spark, d).select("piece", "measure", "beat", (c("conf") * 10).alias("note_conf"),
        F.when(c("qty") < 3, 0.5).otherwise(1.0).alias("beat_conf"),
        F.when(F.expr("partkey % 19 = 0"), 0.3).otherwise(1.0).alias("measure_conf"))
    return needs_review(n, ["piece", "measure", "beat"])


@register(
    "prj10_beat_confidence",
    sql(
        "v_notes",
        """select piece, measure, beat, round_even(min(qty / 60.0::double) * coalesce(min(conf * 10), 1.0)
            * case when min(fret) > 3 then 1.0 else 0.5 end, 3) conf from v_notes group by piece, measure, beat""",
    ),
)
def _(spark, d):
    from scorelake.operators.review import beat_confidence

    n = t.notes(spark, d).groupBy("piece", "measure", "beat").agg(
        F.min(c("qty") / 60.0).alias("share"), F.min(c("conf") * 10).alias("note"), F.min("fret").alias("f")
    )
    return n.select("piece", "measure", "beat", beat_confidence(c("share"), c("note"), c("f") > 3).alias("conf"))


EVIDENCE_SQL = """ev as (select piece, measure, pos, partkey % 5 <> 0 stem, suppkey % 4 beams, conf * 10 beam_conf,
    linenumber % 2 = 1 dot, tuplet, qty % 7 = 0 circled, case partkey % 11 when 0 then 'rest_block' when 1 then 'rest_4'
    when 2 then 'rest_8' when 3 then 'rest_16' end rest_kind, qty % 5 = 0 short_stem,
    case when fret > 5 then cast(1 as bigint) << (suppkey % 6) end guess from v_notes)"""
READINGS_SQL = (
    EVIDENCE_SQL,
    "rb as (select * from (values ('rest_block', 1, 0.5::double), ('rest_block', 2, 0.45), ('rest_4', 4, 0.9), ('rest_8', 8, 0.9), ('rest_16', 16, 0.9)) x(rest_kind, v, p))",
    """rr as (select piece, measure, pos, unnest([v, v, v * 2, v // 2]) d, unnest([0, 1, 0, 0]) k, null::bigint tup,
        unnest([p, p * 0.08::double, p * 0.05::double, p * 0.05::double]) p from ev join rb using (rest_kind))""",
    """st as (select *, 4 << beams bm, case when beams = 0 and (short_stem or circled) then 2 else 4 << beams end d,
        case when dot then 1 else 0 end k, case when beam_conf >= 0.7 then 0.9::double else 0.7 end pc
        from ev where rest_kind is null and stem)""",
    """sr as (select piece, measure, pos, unnest([d, d, bm * 2, bm // 2, case when d = 2 then 4 else 2 end, d]) d,
        unnest([k, 1 - k, k, k, k, k]) k, unnest([tuplet, tuplet, tuplet, tuplet, tuplet, null]) tup,
        unnest([pc, 0.03::double, (1 - pc) * 0.5::double, case when beams > 0 then (1 - pc) * 0.5::double else 0 end,
          case when beams > 0 then 0 when d = 2 then 0.01::double else 0.08 end,
          case when tuplet is not null then 0.05::double else 0 end]) p from st)""",
    """cr as (select piece, measure, pos, unnest([1, 2, 1, 2]) d, unnest([0, 0, 1, 1]) k, null::bigint tup,
        unnest([0.85::double, 0.08, 0.02, 0.02]) p from ev where rest_kind is null and not stem and circled)""",
    """gr as (select piece, measure, pos, v d, k, null::bigint tup, b * pow(0.25::double, abs(log2(v) - log2(coalesce(guess, 4)))) p
        from ev, (select unnest([1, 2, 4, 8, 16, 32]) v), (values (0, 0.4::double), (1, 0.05)) x(k, b)
        where rest_kind is null and not stem and not circled)""",
    """readings as (select piece, measure, pos, cast(d as bigint) duration, cast(k as bigint) dots, tup tuplet, max(p) p
        from (select * from rr union all select * from sr union all select * from cr union all select * from gr)
        where d in (1, 2, 4, 8, 16, 32) and p > 0 group by all)""",
)


def evidence(spark, d):
    return evidence_of(t.notes(spark, d))


def evidence_of(n):
    kind = F.expr("case partkey % 11 when 0 then 'rest_block' when 1 then 'rest_4' when 2 then 'rest_8' when 3 then 'rest_16' end")
    return n.select(
        "piece", "measure", "pos", "tuplet",
        F.expr("partkey % 5 <> 0").alias("stem"), F.expr("suppkey % 4").alias("beams"),
        (c("conf") * 10).alias("beam_conf"), F.expr("linenumber % 2 = 1").alias("dot"),
        F.expr("qty % 7 = 0").alias("circled"), kind.alias("rest_kind"),
        F.expr("qty % 5 = 0").alias("short_stem"),
        F.expr("case when fret > 5 then shiftleft(1L, cast(suppkey % 6 as int)) end").alias("guess"),
    )


def options(spark, d):
    return options_of(t.notes(spark, d))


def options_of(n):
    return timing.with_readings(
        evidence_of(n), "options", spacing_guess="guess",
        **{x: x for x in ("stem", "beams", "beam_conf", "dot", "tuplet", "circled", "rest_kind", "short_stem")},
    )


@register("prj11_candidate_readings", sql("v_notes", *READINGS_SQL, "select piece, pos, duration, dots, tuplet, round(p, 9) p from readings"))
def _(spark, d):
    return options(spark, d).select("piece", "pos", F.explode_outer("options").alias("o")).select(
        "piece", "pos", "o.duration", "o.dots", "o.tuplet", F.round("o.p", 9).alias("p")
    )


@register(
    "prj12_dotted_rest_preference",
    sql(
        "v_notes",
        *READINGS_SQL,
        """select r.piece, r.pos, duration, dots, r.tuplet, round(p * case when rest_kind is not null and dot then
            case when dots > 0 then 12.0::double else 0.1 end else 1 end, 9) p
           from readings r join ev using (piece, pos)""",
    ),
)
def _(spark, d):
    o = options(spark, d).withColumn(
        "options", timing.dotted_rest_preference(c("options"), c("rest_kind"), c("dot"))
    )
    return o.select("piece", "pos", F.explode_outer("options").alias("o")).select(
        "piece", "pos", "o.duration", "o.dots", "o.tuplet", F.round("o.p", 9).alias("p")
    )


SOLVE_SQL = (
    *READINGS_SQL,
    "rd as (select *, pos - (measure - 1) * 4 i from readings)",
    f"cand as (select piece, measure, i, cast({LEN_SQL} as bigint) len, ln(p) lp, p, duration, dots, tuplet from rd)",
    """tops as (select piece, measure, i, max(p) p,
        arg_max(duration, p) d from cand group by piece, measure, i)""",
    "sizes as (select piece, measure, count(*) n, sum(ln(p)) fallback from tops group by piece, measure)",
)


@register(
    "udf2_exact_sum",
    sql(
        "v_notes",
        *SOLVE_SQL,
        # the likeliest reading, first on a tie: p only ties between readings of spacing alone
        """top as (select piece, measure, i, duration d, dots k, tuplet tp, ln(p) lp from cand
            qualify row_number() over (partition by piece, measure, i order by p desc, abs(log2(duration) - 0.1), dots) = 1)""",
        """tri as (select a.piece, a.measure, a.i, a.d, cast(80640 * 2 // a.d as bigint) len, a.lp + b.lp + e.lp + ln(0.02::double) lp
            from top a join top b on a.piece = b.piece and a.measure = b.measure and b.i = a.i + 1
            join top e on a.piece = e.piece and a.measure = e.measure and e.i = a.i + 2
            where a.d = b.d and a.d = e.d and a.k + b.k + e.k = 0 and a.tp is null and b.tp is null and e.tp is null)""",
        "s1 as (select piece, measure, len tot, max(lp) lp from cand where i = 1 and len <= 80640 group by all)",
        """s2 as (select piece, measure, tot + len tot, max(s.lp + c.lp) lp from s1 s join cand c using (piece, measure)
            where i = 2 and tot + len <= 80640 group by all)""",
        """s3 as (select piece, measure, tot, max(lp) lp from (select piece, measure, tot + len tot, s.lp + c.lp lp
            from s2 s join cand c using (piece, measure) where i = 3 union all
            select piece, measure, len, lp from tri where i = 1) where tot <= 80640 group by all)""",
        """s4 as (select piece, measure, tot, max(lp) lp from (select piece, measure, tot + len tot, s.lp + c.lp lp
            from s3 s join cand c using (piece, measure) where i = 4 union all
            select piece, measure, tot + len, s.lp + t.lp from s1 s join tri t using (piece, measure) where i = 2)
            where tot <= 80640 group by all)""",
        """fin as (select *, 1 n from s1 union all select *, 2 from s2 union all select *, 3 from s3
            union all select *, 4 from s4)""",
        """select z.piece, z.measure, f.lp is not null ok, round(coalesce(f.lp, fallback), 6) score
           from sizes z left join fin f on f.piece = z.piece and f.measure = z.measure and f.n = z.n and tot = 80640""",
    ),
)
def _(spark, d):
    return solved(spark, d).groupBy("piece", "measure").agg(
        F.first("ok").alias("ok"), F.round(F.first("score"), 6).alias("score")
    )


def solved(spark, d):
    o = options(spark, d).select("piece", "measure", "pos", "options", F.lit(tk.TICKS).cast("long").alias("room"))
    return timing.solve_measures(o, ["piece", "measure"], "pos", "options", "room")


@register("udf2_chosen_durations")
def _(spark, d):
    return solved(spark, d).select(
        "piece", "measure", "pos", "duration", "dots", "tuplet", "ok", F.round(c("p") / c("total"), 6).alias("share")
    )


# The closed rule for a voice: start = max(onset, end so far), walked beat by beat.
BEATS_SQL = f"""beats as (select piece, measure, suppkey % 2 + 1 voice, pos, fret % 8 * 10080 onset,
    duration, dots, tuplet, partkey % 6 = 0 rest, cast({LEN_SQL} as bigint) own,
    80640 // 4 * (3 + measure % 2) cap, step, octave, case qty % 4 when 0 then 'x' when 1 then 'circle-x'
    when 2 then 'hollow' else 'normal' end head, qty % 5 = 0 open_, linenumber = 3 ghost, tied accent from v_notes)"""
# A voice walked beat by beat; a measure has four beats at most.


def _walk_sql() -> tuple[str, ...]:
    parts = [
        PLAIN_SQL,
        BEATS_SQL,
        "ordered as (select *, row_number() over (partition by piece, measure, voice order by onset, pos) i from beats)",
        "w0 as (select piece, measure, voice, 0::bigint at_ from ordered group by all)",
    ]
    for i in range(1, 5):
        parts.append(
            f"""a{i} as (select o.*, greatest(o.onset, w.at_) start from ordered o join w{i - 1} w
                using (piece, measure, voice) where o.i = {i} and greatest(o.onset, w.at_) < o.cap)"""
        )
        parts.append(
            f"""r{i} as (select a.piece, a.measure, a.voice, a.i, a.pos, a.start, a.cap, a.own, a.duration, a.dots, a.tuplet,
                a.rest, least(coalesce(min(n.onset), max(a.cap)), max(a.cap)) - max(a.start) room from a{i} a left join ordered n
                on n.piece = a.piece and n.measure = a.measure and n.voice = a.voice and n.i > a.i and n.onset > a.start
                group by all)"""
        )
        parts.append(
            f"""p{i} as (select r.piece, r.measure, r.voice, r.i, r.pos, r.start, r.cap,
                case when own > room then coalesce(f.v, 1260) else own end length,
                case when own > room then coalesce(f.d, 64) else duration end duration,
                case when own > room then coalesce(f.k, 0) else dots end dots,
                case when own > room then null else tuplet end tuplet, rest
                from r{i} r asof left join (select * from plain where k < 2) f on f.v <= r.room)"""
        )
        parts.append(f"w{i} as (select piece, measure, voice, start + length at_ from p{i})")
    parts.append("placed as (" + " union all ".join(f"select * from p{i}" for i in range(1, 5)) + ")")
    return tuple(parts)


PLACED_SQL = _walk_sql()


def drum_beats(spark, d):
    return drum_beats_of(t.notes(spark, d))


def drum_beats_of(notes):
    return notes.select(
        "piece", "measure", F.expr("suppkey % 2 + 1").alias("voice"), "pos",
        F.expr("fret % 8 * 10080").alias("onset"), "duration", "dots", "tuplet",
        F.expr("partkey % 6 = 0").alias("rest"),
        F.expr("80640 div 4 * (3 + measure % 2)").alias("cap"), "step", "octave",
        F.expr("case qty % 4 when 0 then 'x' when 1 then 'circle-x' when 2 then 'hollow' else 'normal' end").alias("head"),
        F.expr("qty % 5 = 0").alias("open_"), F.expr("linenumber = 3").alias("ghost"), c("tied").alias("accent"),
    )


VOICE = ["piece", "measure", "voice"]


def placed(spark, d, extra=()):
    return timing.placed_voices(drum_beats(spark, d), VOICE, "cap", extra)


@register("udf4_writable_voice", sql("v_notes", *PLACED_SQL, "select piece, measure, voice, pos, start, length, duration, dots, tuplet, rest from placed"))
def _(spark, d):
    return placed(spark, d).drop("cap")


@register(
    "win12_gap_rows",
    sql(
        "v_notes",
        *PLACED_SQL,
        """gaps as (select piece, measure, voice, coalesce(lag(start + length) over (partition by piece, measure, voice
            order by start), 0) a, start b from placed union all
            select piece, measure, voice, max(start + length), max(cap) from placed group by piece, measure, voice)""",
        "select piece, measure, voice, a start, b - a length from gaps where b > a",
    ),
)
def _(spark, d):
    return timing.gap_rows(placed(spark, d), VOICE, "cap")


@register(
    "win13_beam_groups",
    sql(
        "v_notes",
        *PLACED_SQL,
        """lv as (select *, case when rest then 0 else coalesce(case duration when 8 then 1 when 16 then 2 when 32 then 3
            when 64 then 4 end, 0) end n, start // 20160 bt from placed)""",
        """jn as (select *, coalesce(n > 0 and lag(n) over w > 0 and lag(bt) over w = bt and lag(start + length) over w = start, false) joined
            from lv window w as (partition by piece, measure, voice order by start))""",
        "gp as (select *, sum(case when joined then 0 else 1 end) over (partition by piece, measure, voice order by start) g from jn)",
        """ks as (select *, row_number() over (partition by piece, measure, voice, g order by start) k,
            count(*) over (partition by piece, measure, voice, g) size from gp)""",
        "ls as (select *, unnest(range(1, n + 1)) level from ks where size > 1 and n > 0)",
        "rs as (select *, k - row_number() over (partition by piece, measure, voice, g, level order by k) gap from ls)",
        """js as (select *, row_number() over (partition by piece, measure, voice, g, level, gap order by k) ri,
            count(*) over (partition by piece, measure, voice, g, level, gap) al from rs)""",
        """select piece, measure, voice, pos, level, case when al = 1 and k = 1 then 'forward hook' when al = 1 then
            'backward hook' when ri = 1 then 'begin' when ri = al then 'end' else 'continue' end kind from js""",
    ),
)
def _(spark, d):
    return timing.beams(placed(spark, d), VOICE, F.lit(tk.TICKS // 4))


@register(
    "win3_sequential_onsets",
    sql(
        "v_notes",
        f"lens as (select piece, measure, pos, cast({LEN_SQL} as bigint) len from v_notes)",
        """select piece, pos, cast(coalesce(sum(len) over (partition by piece, measure order by pos
            rows between unbounded preceding and 1 preceding), 0) as bigint) onset from lens""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    w = Window.partitionBy("piece", "measure").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("len", length_of(n)).select(
        "piece", "pos", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("onset")
    )


KEY_SQL = "keyed as (select *, case when pos % 4 = 1 then suppkey % 9 - 4 end sig from v_notes)"
ALTER_SQL = """case when key_ > 0 and instr('FCGDAEB', step) <= key_ then 1
    when key_ < 0 and 8 - instr('FCGDAEB', step) <= -key_ then -1 else 0 end"""


@register(
    "win5_accidentals",
    sql(
        "v_notes",
        KEY_SQL,
        "inforce as (select *, coalesce(last_value(sig ignore nulls) over (partition by piece order by pos), 0) key_ from keyed)",
        f"""held as (select *, coalesce(lag(alter_) over (partition by piece, measure, step, octave order by pos),
            {ALTER_SQL}) expected from inforce)""",
        """select piece, pos, expected, alter_ <> expected and not tied and fret % 5 <> 0 drawn, case when alter_ <> expected and not tied
            and fret % 5 <> 0 then case alter_ when -1 then 'flat' when 0 then 'natural' when 1 then 'sharp' end end mark from held""",
    ),
)
def _(spark, d):
    from scorelake.operators.notation import accidentals

    n = t.notes(spark, d).withColumn("sig", F.expr("case when pos % 4 = 1 then suppkey % 9 - 4 end"))
    keyed = scan(n, "piece", "pos", {"key_": latest(c("sig"))})
    keyed = keyed.withColumn("key_", F.coalesce("key_", F.lit(0))).withColumn("has_mark", F.expr("fret % 5 = 0"))
    return accidentals(keyed, ["piece", "measure"], "pos")


@register(
    "win14_running_length",
    sql(
        "v_notes",
        f"""steps as (select piece, measure, pos, case partkey % 4 when 0 then -1 when 1 then 0 else 1 end *
            cast({LEN_SQL} as bigint) s from v_notes)""",
        "at_ as (select *, sum(s) over (partition by piece, measure order by pos) p from steps)",
        "select piece, measure, cast(greatest(max(p), 0) as bigint) len from at_ group by piece, measure",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    sign = F.expr("case partkey % 4 when 0 then -1 when 1 then 0 else 1 end")  # backup, chord, note
    w = Window.partitionBy("piece", "measure").orderBy("pos")
    at = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("s", sign * length_of(n)).withColumn("p", at).groupBy("piece", "measure").agg(
        F.greatest(F.max("p"), F.lit(0)).alias("len")
    )


@register(
    "jn8_interpolated_onsets",
    sql(
        "v_notes",
        "rowsx as (select piece, measure, pos, (pos - 1) % 4 * 100 + fret * 3 x, fret % 8 * 10080 o from v_notes)",
        """anchors as (select piece, measure, x ax, o ao from rowsx where pos % 2 = 1 union all
            select distinct piece, measure, 480, 80640 from rowsx)""",
        """near as (select e.piece, e.measure, e.pos, e.x,
            min_by(ax, abs(ax - x) * 100000000 + ax * 100000 + ao) nx, min_by(ao, abs(ax - x) * 100000000 + ax * 100000 + ao) no_,
            max(ax) filter (ax < x) lx, max_by(ao, ax * 100000 - ao) filter (ax < x) lo,
            min(ax) filter (ax > x) rx, min_by(ao, ax * 100000 + ao) filter (ax > x) ro
            from rowsx e join anchors a using (piece, measure) where pos % 2 = 0 group by all)""",
        "fr as (select *, (x - lx) / (rx - lx)::double f from near)",
        """qs as (select piece, pos, min_by({'q': q, 'p': cast(round_even(f * q, 0) as bigint)},
            [abs(f - round_even(f * q, 0) / q), q]) z from fr, (select unnest(range(1, 65)) q)
            where lx is not null and rx is not null group by piece, pos)""",
        "ts as (select fr.*, lo * z.q + (ro - lo) * z.p top, z.q * 5040 bot from fr left join qs z using (piece, pos))".replace("left join qs z using", "left join qs using"),
        "hs as (select *, cast(floor(top / bot) as bigint) w from ts)",
        "us as (select *, w + case when (top - w * bot) * 2 > bot then 1 when (top - w * bot) * 2 < bot then 0 else w % 2 end g from hs)",
        """select piece, measure, pos, case when abs(nx - x) <= 9 or lx is null or rx is null then no_
            else least(80640 - 5040, greatest(0, g * 5040)) end onset, abs(nx - x) <= 9 exact from us""",
    ),
)
def _(spark, d):
    rows = t.notes(spark, d).select(
        "piece", "measure", "pos", F.expr("(pos - 1) % 4 * 100 + fret * 3").alias("x"),
        F.expr("fret % 8 * 10080").alias("onset"),
    )
    bar = rows.select("piece", "measure").distinct().select(
        "piece", "measure", F.lit(480).cast("long").alias("x"), F.lit(tk.TICKS).cast("long").alias("onset")
    )
    anchors = rows.where("pos % 2 = 1").select("piece", "measure", "x", "onset").unionByName(bar)
    events = rows.where("pos % 2 = 0").drop("onset").withColumn("cap", F.lit(tk.TICKS).cast("long"))
    out = timing.aligned_onsets(events, anchors, ["piece", "measure"], 9, 5040, "cap")
    return out.select("piece", "measure", "pos", "onset", "exact")


# ---------------------------------------------------------------------- small choices


@register(
    "prj13_time_choice",
    sql(
        "v_systems",
        """sig as (select piece, seq, case when piece % 5 = 0 then '3/4' end chosen,
            case when chars % 3 = 0 then cast(2 + chars % 5 as varchar) || '/4' end printed from v_systems)""",
        """select piece, seq, coalesce(chosen, printed, min_by(printed, seq) filter (printed is not null)
            over (partition by piece), '4/4') time_ from sig""",
    ),
)
def _(spark, d):
    rows = t.systems(spark, d).select(
        "piece", "seq", F.expr("case when piece % 5 = 0 then '3/4' end").alias("chosen"),
        F.expr("case when chars % 3 = 0 then cast(2 + chars % 5 as string) || '/4' end").alias("printed"),
    )
    found = rows.groupBy("piece").agg(
        F.min_by("printed", F.when(c("printed").isNotNull(), c("seq"))).alias("detected")
    )
    return rows.join(found, "piece").select(
        "piece", "seq", F.coalesce("chosen", "printed", "detected", F.lit("4/4")).alias("time_")
    )


@register(
    "prj14_retry_variant",
    sql("v_edits", "select seq, case value_ % 3 when 1 then 1.5::double when 2 then 0.85 else 1.0 end scale, case value_ % 3 when 1 then 40 when 2 then 20 else 0 end margin_ from v_edits"),
)
def _(spark, d):
    v = F.pmod(c("value"), F.lit(3))
    return t.edits(spark, d).select(
        "seq", F.when(v == 1, 1.5).when(v == 2, 0.85).otherwise(1.0).alias("scale"),
        F.when(v == 1, 40).when(v == 2, 20).otherwise(0).alias("margin_"),
    )


@register(
    "prj15_beat_of_time",
    sql(
        "v_edits",
        "tm as (select seq, 2 + value_ % 11 num, cast(1 as bigint) << (1 + seq % 4) den from v_edits)",
        """select seq, num, den, case when den = 8 and num % 3 = 0 and num > 3 then 30240 else 80640 // den end beat,
            num * 80640 // den cap from tm""",
    ),
)
def _(spark, d):
    e = t.edits(spark, d).select(
        "seq", F.expr("2 + value % 11").alias("num"), F.expr("shiftleft(1L, cast(1 + seq % 4 as int))").alias("den")
    )
    return e.select("seq", "num", "den", tk.beat_ticks(c("num"), c("den")).alias("beat"), tk.capacity(c("num"), c("den")).alias("cap"))


# Numerators and denominators of the time signatures that are known.
TIME_NUMS, TIME_DENS = (2, 3, 4, 5, 6, 7, 9, 12), (2, 4, 8, 16)


@register(
    "prj17_valid_settings",
    sql(
        "v_edits",
        "st as (select seq, 1 + value_ % 13 num, cast(1 as bigint) << (seq % 6) den, piece % 450 tempo from v_edits)",
        """select seq, num, den, tempo from st where num in (2, 3, 4, 5, 6, 7, 9, 12) and den in (2, 4, 8, 16)
           and tempo between 20 and 400""",
    ),
)
def _(spark, d):
    e = t.edits(spark, d).select(
        "seq", F.expr("1 + value % 13").alias("num"),
        F.expr("shiftleft(1L, cast(seq % 6 as int))").alias("den"), F.expr("piece % 450").alias("tempo"),
    )
    return e.where(c("num").isin(*TIME_NUMS) & c("den").isin(*TIME_DENS) & c("tempo").between(20, 400))


@register(
    "agg7_measure_fill",
    sql(
        "v_notes",
        f"""select piece, measure, cast(sum({LEN_SQL}) as bigint) used, 80640 // 4 * (3 + measure % 2) cap,
            sum({LEN_SQL}) = 80640 // 4 * (3 + measure % 2) full_ from v_notes group by piece, measure""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    cap = F.expr("80640 div 4 * (3 + measure % 2)")
    return n.groupBy("piece", "measure").agg(F.sum(length_of(n)).alias("used")).withColumn("cap", cap).withColumn(
        "full_", c("used") == c("cap")
    )


# --------------------------------------------------------------------------- texts


NAMES_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


def midi_sql(e):
    return f"({NAMES_SQL}[({e}) % 12 + 1] || cast(({e}) // 12 - 1 as varchar))"


@register(
    "fn1_midi_names",
    sql(
        "v_notes",
        f"""nm as (select piece, pos, partkey % 128 midi, {midi_sql('partkey % 128')} name,
            lower(step) || case alter_ when 1 then '#' when -1 then 'b' else '' end || cast(octave + fret % 7 as varchar) txt from v_notes)""",
        """pr as (select *, (octave_ + 1) * 12 + case upper(txt[1]) when 'C' then 0 when 'D' then 2 when 'E' then 4
            when 'F' then 5 when 'G' then 7 when 'A' then 9 else 11 end + case when contains(txt, '#') then 1
            when txt[2] = 'b' then -1 else 0 end m from (select *, try_cast(regexp_extract(txt, '[0-9]+$') as int) octave_ from nm))""",
        """select piece, pos, midi, name, txt, cast(case when octave_ <= 9 and m between 0 and 127 then m end as integer) back
           from pr""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d).select(
        "piece", "pos", F.expr("partkey % 128").alias("midi"),
        F.expr("lower(step) || case alter_ when 1 then '#' when -1 then 'b' else '' end || cast(octave + fret % 7 as string)").alias("txt"),
    )
    return n.withColumns({"name": mu.midi_name(c("midi")), "back": mu.name_midi(c("txt"))})


@register(
    "fn2_tuning_text",
    sql(
        "v_edits",
        f"tn as (select seq, [40 + value_ % 3, 45 + seq % 2, 50 + value_ % 5, 55 + target, 59, 64 - value_ % 4] t from v_edits)",
        f"tx as (select seq, array_to_string(list_transform(list_reverse(t), lambda m: {NAMES_SQL}[m % 12 + 1] || cast(m // 12 - 1 as varchar)), ' ') txt, t from tn)",
        "select seq, txt, array_to_string(t, ',') parsed from tx",
    ),
)
def _(spark, d):
    e = t.edits(spark, d).select("seq", F.expr(
        "array(40 + value % 3, 45 + seq % 2, 50 + value % 5, 55 + target, 59L, 64 - value % 4)").alias("t"))
    e = e.withColumn("txt", mu.tuning_text(c("t")))
    return e.select("seq", "txt", F.array_join(mu.parse_tuning(c("txt"), F.lit(6)).cast("array<string>"), ",").alias("parsed"))


@register(
    "fn3_default_tuning",
    sql(
        "v_edits",
        "st as (select seq, 4 + value_ % 6 n from v_edits)",
        """select seq, n, case n when 6 then '40,45,50,55,59,64' when 7 then '35,40,45,50,55,59,64' else
            array_to_string(list_transform(range(n - 1, -1, -1), lambda i: 64 - i * 5 + case when i >= 2 then 1 else 0 end), ',') end tuning from st""",
    ),
)
def _(spark, d):
    e = t.edits(spark, d).select("seq", F.expr("4 + value % 6").alias("n"))
    return e.withColumn("tuning", F.array_join(mu.default_tuning(c("n")).cast("array<string>"), ","))


@register(
    "fn4_staff_steps",
    sql(
        "v_drum",
        "st as (select note_id, step, octave, instr('CDEFGAB', step) - 1 + 7 * octave - 30 place from v_drum)",
        """select note_id, place, substr('CDEFGAB', cast((place - 3 + 30) % 7 + 1 as int), 1) step3,
            (place - 3 + 30) // 7 octave3 from st""",
    ),
)
def _(spark, d):
    n = t.drum_notes(spark, d).select("note_id", mu.staff_step(c("step"), c("octave")).alias("place"))
    return n.withColumn("p", mu.position(c("place") - 3)).select(
        "note_id", "place", c("p.step").alias("step3"), c("p.octave").alias("octave3")
    )


@register(
    "fn5_key_alters",
    sql(
        "v_systems",
        "st as (select piece, seq, fifths key_, unnest(['C','D','E','F','G','A','B']) step from v_systems where fifths is not null)",
        f"select piece, seq, step, cast({ALTER_SQL} as bigint) alter_ from st",
    ),
)
def _(spark, d):
    s = t.systems(spark, d).where("fifths is not null")
    s = s.withColumn("step", F.explode(F.split(F.lit("C D E F G A B"), " ")))
    return s.select("piece", "seq", "step", mu.key_alter(c("step"), c("fifths")).alias("alter_"))


@register(
    "fn6_lookup_keys",
    sql(
        "v_drum",
        """ks as (select note_id, step || cast(octave as varchar) || ':' || case when notehead in ('normal', 'hollow') then 'normal'
            else notehead end || case when open_ then ':open' else '' end k, size_ from v_drum)""",
        """select note_id, k, regexp_matches(case when size_ % 9 = 0 then k || ':ajar' else k end,
            '^[A-G][0-9]:(normal|x|circle-x)(:open)?$') valid from ks""",
    ),
)
def _(spark, d):
    n = t.drum_notes(spark, d).select(
        "note_id", "size_", mu.note_key(c("step"), c("octave"), c("notehead"), c("open_")).alias("k")
    )
    tried = F.when(c("size_") % 9 == 0, F.concat("k", F.lit(":ajar"))).otherwise(c("k"))
    return n.select("note_id", "k", mu.valid_key(tried).alias("valid"))


@register(
    "fn7_clock",
    sql(
        "v_frames",
        """sec as (select event_id, t_us // 100000 tenths from v_frames)""",
        """select event_id, cast(tenths // 600 as varchar) || ':' || lpad(cast(tenths % 600 // 10 as varchar), 2, '0')
            || '.' || cast(tenths % 10 as varchar) clock from sec""",
    ),
)
def _(spark, d):
    return t.frames(spark, d).select("event_id", mu.clock(F.expr("t_us div 100000") / 10).alias("clock"))


@register(
    "fn8_quote",
    sql("", """select doc_id, length(q) n, q from (select doc_id, '"' || replace(replace(regexp_replace(text,
        '[\\r\\n]+', ' ', 'g'), '\\', '\\\\'), '"', '\\"') || '"' q from documents)"""),
)
def _(spark, d):
    q = mu.quote(c("text"))
    return t.table(spark, d, "documents").select("doc_id", q.alias("q")).withColumn("n", F.length("q").cast("long"))


@register(
    "fn9_bend_amount",
    sql(
        "v_notes",
        """select piece, pos, case partkey % 4 when 0 then 2.0::double when 1 then case when suppkey % 3 = 0 then 1.0
            else 2.0 * (suppkey % 3) + 1 end when 2 then case when fret % 4 = 0 then 2.0 else 2.0 * (fret % 4) end
            else 2.0 end semitones from v_notes""",
    ),
)
def _(spark, d):
    from scorelake.operators.notation import bend_amount

    n = t.notes(spark, d)
    kind = F.expr("case partkey % 4 when 0 then 'word' when 1 then 'fraction' when 2 then 'digit' end")
    digit = F.expr("case when partkey % 4 = 1 then suppkey % 3 else fret % 4 end")
    return n.select("piece", "pos", bend_amount(kind, digit).alias("semitones"))


@register(
    "fn10_packed_flags",
    sql(
        "",
        """ks as (select event_id, cast(json_extract(props, '$.k') as bigint) k from events)""",
        """select event_id, case when k & 1 > 0 then 'shift' when k & 2 > 0 then 'legato' when k & 4 > 0 then 'out_down'
            when k & 8 > 0 then 'out_up' end slide, case when k & 16 > 0 then 'below' when k & 32 > 0 then 'above' end slide_in,
            k & 1 > 0 staccato, case when greatest(k, k * 3 % 100, k * 7 % 100) > 0 then greatest(k, k * 3 % 100, k * 7 % 100) / 50.0::double end bend,
            greatest(k, k * 3 % 100, k * 7 % 100) > 0 and k * 7 % 100 < greatest(k, k * 3 % 100, k * 7 % 100)
              and k * 3 % 100 >= greatest(k, k * 3 % 100, k * 7 % 100) release from ks""",
    ),
)
def _(spark, d):
    from scorelake.operators.notation import bend_points, slide_flags

    e = t.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    bend = bend_points(c("k"), c("k") * 3 % 100, c("k") * 7 % 100)
    out, into = slide_flags(c("k"))
    return e.select(
        "event_id", out.alias("slide"), into.alias("slide_in"),
        (c("k").bitwiseAND(F.lit(1)) > 0).alias("staccato"), bend["bend"].alias("bend"), bend["release"].alias("release"),
    )


@register(
    "fn11_velocity_tempo",
    sql(
        "v_edits",
        """select seq, case when op = 'F' then 40 when op = 'O' then 120 else 96 end velocity, greatest(20, least(400, piece)) tempo,
            60000000 // greatest(20, least(400, piece)) micros from v_edits""",
    ),
)
def _(spark, d):
    from scorelake.operators.notation import clamp_tempo, quarter_micros, velocity

    e = t.edits(spark, d)
    tempo = clamp_tempo(c("piece"))
    return e.select("seq", velocity(c("op") == "F", c("op") == "O").alias("velocity"), tempo.alias("tempo"), quarter_micros(tempo).alias("micros"))


@register(
    "fn12_rhythm_text",
    sql(
        "v_notes",
        """select piece, pos, cast(duration as varchar) || repeat('.', dots) || coalesce('/' || cast(tuplet as varchar), '')
            || ':' || case when partkey % 6 = 0 then 'R' else cast(string_ as varchar) || ':' || case when tied then '~' else '' end
            || cast(fret as varchar) end txt from v_notes""",
    ),
)
def _(spark, d):
    note = F.concat(c("string_").cast("string"), F.lit(":"), F.when(c("tied"), "~").otherwise(""), c("fret").cast("string"))
    body = F.when(F.expr("partkey % 6 = 0"), "R").otherwise(note)
    return t.notes(spark, d).select(
        "piece", "pos", F.concat(mu.rhythm(c("duration"), c("dots"), c("tuplet")), F.lit(":"), body).alias("txt")
    )


@register(
    "fn13_track_names",
    sql("v_systems", "select piece, seq, case when count(*) over (partition by piece) = 1 then 'Guitar' else 'Guitar ' || cast(seq + 1 as varchar) end name from v_systems"),
)
def _(spark, d):
    s = t.systems(spark, d)
    n = s.groupBy("piece").agg(F.count("*").alias("n"))
    return s.join(n, "piece").select("piece", "seq", mu.track_name(c("seq"), c("n")).alias("name"))


@register(
    "fn14_gate_ticks",
    sql(
        "v_notes",
        f"""select piece, pos, cast(round_even({LEN_SQL} / 42.0::double, 0) as bigint) ticks,
            greatest(1, cast(round_even(least({LEN_SQL}, 5040) / 42.0::double, 0) as bigint)) gate from v_notes""",
    ),
)
def _(spark, d):
    from scorelake.operators.notation import gate, quarter_ticks

    n = t.notes(spark, d)
    return n.select("piece", "pos", quarter_ticks(length_of(n)).alias("ticks"), gate(length_of(n)).alias("gate"))


@register(
    "fn16_shape_features",
    sql(
        "v_boxes",
        """select frame, item, supp, line_ * 4 / 10.0::double hs, (x1 - x0) / 10.0::double ws, round(ln((x1 - x0) / (line_ * 4.0::double)), 9) ratio,
            round(supp / ((x1 - x0) * line_ * 4.0::double), 9) fill from v_boxes""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    f = bx.shape_features(c("x1") - c("x0"), c("line_") * 4, c("supp"), 10.0)
    return b.select("frame", "item", "supp", f.alias("f")).select(
        "frame", "item", "supp", "f.hs", "f.ws", F.round("f.ratio", 9).alias("ratio"), F.round("f.fill", 9).alias("fill")
    )
