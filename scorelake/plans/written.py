"""Instrument lookup and the written forms: notation rows, event rows, text rows, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators import mapping as mp
from scorelake.operators import notation as nt
from scorelake.operators import timing
from scorelake.operators.numbering import changed_attributes
from scorelake.operators.ordered import previous, row_number, running_sum, scan, whole_like
from scorelake.plans.registry import register, sql
from scorelake.plans.score import LEN_SQL, PLACED_SQL, VOICE, drum_beats, drum_beats_of, placed
from scorelake.sources import tables as t

c = F.col


def _values(preset: dict) -> str:
    rows = []
    for i, (key, gm) in enumerate(preset.items()):
        pos, family, *op = key.split(":")
        rows.append(f"('{pos[0]}', {pos[1]}, '{family}', {'true' if op else 'false'}, {gm}, {i}, '{key}')")
    return ", ".join(rows)


OWN = {"C5:x": 39, "G5:x": 54, "C4:normal": 41}
MAP_SQL = f"mp as (select * from (values {_values(mp.DEFAULT | OWN)}) x(s, o, f, op, gm, ord, key))"
PLACE = "instr('CDEFGAB', {0}) - 1 + 7 * {1}"


def resolve_sql(source: str, head: str = "notehead") -> tuple[str, ...]:
    """Symbols of ``source`` with their drum, as the sub-query ``res``."""
    here = "m.s = k.step and m.o = k.octave"
    gap = f"({PLACE.format('m.s', 'm.o')} - ({PLACE.format('k.step', 'k.octave')}))"
    rank = f"abs({gap}) * 100000 + ({gap} + 400) * 100 + m.ord"
    return (
        MAP_SQL,
        f"""kinds as (select distinct step, octave, case when {head} in ('normal', 'hollow') then 'normal' else {head} end fam,
            open_ from {source})""",
        f"""tried as (select k.step, k.octave, k.fam, k.open_, max(gm) filter ({here} and f = fam and op and open_) exact_,
            max(gm) filter ({here} and f = fam and not op) plain_, max(gm) filter ({here} and fam = 'circle-x' and f = 'x' and not op) cross_,
            min_by(gm, {rank}) filter (not op and f = case when fam = 'circle-x' then 'x' else fam end) near_,
            min_by(gm, {rank}) filter (not op) any_ from kinds k, mp m group by all)""",
        """other as (select *, coalesce(plain_, cross_, near_, any_) ot from tried)""",
        """res as (select step, octave, fam, open_, cast(coalesce(exact_, case when open_ and ot = 42 then 46 else ot end) as bigint) gm
            from other)""",
    )


def own_table(spark):
    own = spark.createDataFrame(list(OWN.items()), "key string, gm long")
    return mp.with_overrides(mp.preset(spark, "default"), own)


FAM = "case when {0} in ('normal', 'hollow') then 'normal' else {0} end"


@register(
    "jn9_resolve_drums",
    sql("v_drum", *resolve_sql("v_drum"), f"select note_id, gm from v_drum v join res r on r.step = v.step and r.octave = v.octave and r.open_ = v.open_ and r.fam = {FAM.format('notehead')}"),
)
def _(spark, d):
    return mp.resolve(t.drum_notes(spark, d), own_table(spark)).select("note_id", "gm")


@register(
    "jn9_resolve_far_octaves",
    sql("v_drum", "far as (select * replace (octave * 20 - 88 as octave) from v_drum)", *resolve_sql("far"), f"select note_id, gm from far v join res r on r.step = v.step and r.octave = v.octave and r.open_ = v.open_ and r.fam = {FAM.format('notehead')}"),
)
def _(spark, d):
    far = t.drum_notes(spark, d).withColumn("octave", c("octave") * 20 - 88)
    return mp.resolve(far, own_table(spark)).select("note_id", "gm")


@register(
    "jn10_override_table",
    sql(
        "v_drum",
        MAP_SQL.replace("mp as", "whole as"),
        """ks as (select note_id, step || cast(octave as varchar) || ':' || case when notehead in ('normal', 'hollow') then 'normal'
            else notehead end || case when open_ then ':open' else '' end key from v_drum)""",
        """select note_id, key, cast(gm as bigint) gm, key in ('C5:x', 'G5:x', 'C4:normal') overridden from ks join whole using (key)""",
    ),
)
def _(spark, d):
    from scorelake.functions.music import note_key

    n = t.drum_notes(spark, d).select(
        "note_id", note_key(c("step"), c("octave"), c("notehead"), c("open_")).alias("key")
    )
    return n.join(F.broadcast(own_table(spark)), "key").select("note_id", "key", "gm", "overridden")


@register(
    "agg8_key_usage",
    sql(
        "v_drum",
        *resolve_sql("v_drum"),
        f"""used as (select step, octave, {FAM.format('notehead')} fam, open_, count(*) n from v_drum group by all)""",
        """select step || cast(octave as varchar) || ':' || fam || case when open_ then ':open' else '' end key, n, gm,
            step || cast(octave as varchar) || ':' || fam || case when open_ then ':open' else '' end in ('C5:x', 'G5:x', 'C4:normal') overridden
            from used join res using (step, octave, fam, open_)""",
    ),
)
def _(spark, d):
    return mp.usage(t.drum_notes(spark, d), own_table(spark), [])


# ----------------------------------------------------------------- notation per measure


NOTE = ["step", "octave", "head", "open_", "ghost", "accent"]


def written_measures(notes):
    """Measures of notes with their time and that of the one before, and the written notes and gaps of their voices. A
    piece lies in one place, so a measure is made of its notes there."""
    from scorelake.sources.sinks import measure_parts

    where = timing.placed_voices(drum_beats_of(notes), VOICE, "cap", NOTE, in_place=True)
    where = timing.with_gaps(timing.beamed(where, VOICE, F.lit(tk.TICKS // 4)), VOICE, "cap")
    bars = measure_parts(mp.resolve(where, mp.preset(notes.sparkSession, "default"), "head"), "cap")
    return scan(whole_like(bars, notes, "piece"), "piece", "measure", {"before": previous(c("cap"))})


DEF_MAP = MAP_SQL.replace(_values(mp.DEFAULT | OWN), _values(mp.DEFAULT))
RES_SQL = tuple(x.replace(MAP_SQL, DEF_MAP) for x in resolve_sql("beats", "head"))
HEADS_SQL = "hd as (select * from (values " + ", ".join(f"({k}, '{h}')" for k, (_, h) in mp.INSTRUMENTS.items()) + ") x(gm, shape))"
NAMES_SQL = "nm as (select * from (values " + ", ".join(f"({k}, '{v}')" for k, v in tk.VALUE_NAMES.items()) + ") x(duration, kind))"
BEAM_SQL = (
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
    """bm as (select piece, measure, voice, pos, string_agg('<beam number="' || cast(level as varchar) || '">' ||
        case when al = 1 and k = 1 then 'forward hook' when al = 1 then 'backward hook' when ri = 1 then 'begin'
        when ri = al then 'end' else 'continue' end || '</beam>', '' order by level) beams from js group by all)""",
)
XML_SQL = (
    *PLACED_SQL,
    *RES_SQL,
    HEADS_SQL,
    NAMES_SQL,
    *BEAM_SQL,
    f"""nx as (select p.piece, p.measure, p.voice, p.start, p.pos, case when p.rest then
        '<note><rest/><duration>' || cast(cast(p.length // 12 as bigint) as varchar) || '</duration>'
        else '<note><unpitched><display-step>' || b.step || '</display-step><display-octave>' || cast(b.octave as varchar)
          || '</display-octave></unpitched><duration>' || cast(p.length // 12 as varchar) || '</duration><instrument id="P1-I'
          || cast(r.gm as varchar) || '"/>' end
        || '<voice>' || cast(p.voice as varchar) || '</voice><type>' || nm.kind || '</type>' || repeat('<dot/>', p.dots)
        || case when p.tuplet is null then '' else '<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification>' end
        || case when p.rest then '' else '<stem>' || case when p.voice = 1 then 'up' else 'down' end || '</stem>'
          || case when hd.shape <> 'normal' or b.ghost then '<notehead' || case when b.ghost then ' parentheses="yes"' else '' end
             || '>' || hd.shape || '</notehead>' else '' end || coalesce(bm.beams, '')
          || case when b.open_ or r.gm = 46 or b.accent then '<notations>' || case when b.open_ or r.gm = 46 then
             '<technical><open-string/></technical>' else '' end || case when b.accent then '<articulations><accent/></articulations>'
             else '' end || '</notations>' else '' end end || '</note>' x
        from placed p join beats b using (piece, measure, voice, pos) join res r on r.step = b.step and r.octave = b.octave
          and r.open_ = b.open_ and r.fam = {FAM.format('b.head')} join hd on hd.gm = r.gm join nm on nm.duration = p.duration
        left join bm on bm.piece = p.piece and bm.measure = p.measure and bm.voice = p.voice and bm.pos = p.pos)""",
    """gaps as (select piece, measure, voice, coalesce(lag(start + length) over (partition by piece, measure, voice order by start), 0) a,
        start b from placed union all select piece, measure, voice, max(start + length), max(cap) from placed group by piece, measure, voice)""",
    """fw as (select piece, measure, voice, a start, '<forward><duration>' || cast((b - a) // 12 as varchar) || '</duration><voice>'
        || cast(voice as varchar) || '</voice></forward>' x from gaps where b > a)""",
    """vx as (select piece, measure, voice, string_agg(x, '' order by start) x from (select piece, measure, voice, start, x from nx
        union all select * from fw) group by all)""",
    """bars as (select piece, measure, max(cap) cap from beats group by all)""",
    """tm as (select *, lag(cap) over (partition by piece order by measure) before from bars)""",
    """select t.piece, t.measure, '<measure number="' || cast(t.measure as varchar) || '">'
        || case when t.measure = 1 or before <> cap then '<attributes>' || case when t.measure = 1 then
             '<divisions>1680</divisions><key><fifths>0</fifths></key>' else '' end || '<time><beats>' || cast(cap // 20160 as varchar)
             || '</beats><beat-type>4</beat-type></time>' || case when t.measure = 1 then
             '<clef><sign>percussion</sign></clef><staff-details><staff-lines>5</staff-lines></staff-details>' else '' end
             || '</attributes>' else '' end
        || coalesce(v1.x, '<note><rest measure="yes"/><duration>' || cast(cap // 12 as varchar) || '</duration><voice>1</voice></note>')
        || coalesce('<backup><duration>' || cast(cap // 12 as varchar) || '</duration></backup>' || v2.x, '') || '</measure>' xml
       from tm t left join vx v1 on v1.piece = t.piece and v1.measure = t.measure and v1.voice = 1
       left join vx v2 on v2.piece = t.piece and v2.measure = t.measure and v2.voice = 2""",
)


@register("snk2_notation_rows", sql("v_notes", *XML_SQL))
def _(spark, d):
    from scorelake.sources.sinks import measure_xml

    return t.by_notes(spark, d, lambda notes: measure_xml(written_measures(notes)))


EVENTS_SQL = (
    *PLACED_SQL,
    *RES_SQL,
    "bars as (select piece, measure, max(cap) cap from beats group by all)",
    """st as (select *, coalesce(sum(cap) over (partition by piece order by measure rows between unbounded preceding and 1 preceding), 0) s0,
        lag(cap) over (partition by piece order by measure) before from bars)""",
    f"""hits as (select p.piece, p.pos, cast(round_even(s0 / 42.0::double, 0) as bigint) + cast(round_even(p.start / 42.0::double, 0) as bigint) on_,
        greatest(1, cast(round_even(least(p.length, 5040) / 42.0::double, 0) as bigint)) g, r.gm key_,
        case when b.ghost then 40 when b.accent then 120 else 96 end vel
        from placed p join beats b using (piece, measure, voice, pos) join res r on r.step = b.step and r.octave = b.octave
          and r.open_ = b.open_ and r.fam = {FAM.format('b.head')} join st on st.piece = p.piece and st.measure = p.measure
        where not p.rest)""",
    """select piece, on_ tick, 2 ord, 'on' kind, key_, vel velocity from hits union all
       select piece, on_ + g, 1, 'off', key_, 0 from hits union all
       select piece, cast(round_even(s0 / 42.0::double, 0) as bigint), 2, 'meter', cap // 20160, 4 from st where before is distinct from cap union all
       select distinct piece, 0, 1, 'tempo', 60000000 // (20 + piece % 381), 0 from st""",
)


@register("snk3_event_rows", sql("v_notes", *EVENTS_SQL))
def _(spark, d):
    from scorelake.sources.sinks import event_rows

    beats = drum_beats(spark, d)
    bars = beats.groupBy("piece", "measure").agg(F.max("cap").alias("cap"))
    bars = scan(bars, "piece", "measure", {"start_tick": running_sum(c("cap"), False), "before": previous(c("cap"))})
    notes = mp.resolve(placed(spark, d, NOTE), mp.preset(spark, "default"), "head")
    return event_rows(bars, notes, F.expr("20 + piece % 381"))


EFFECTS = {
    "bend": "case when partkey % 5 = 0 then (suppkey % 4) / 2.0D end",
    "bend_release": "qty % 2 = 0",
    "harmonic": "case fret % 7 when 0 then 'natural' when 1 then 'artificial' when 2 then 'pinch' when 3 then 'tap' end",
    "harmonic_fret": "case when fret % 2 = 0 then 5 + fret % 8 end",
    "vibrato": "partkey % 6 = 1",
    "slide_in": "case suppkey % 9 when 1 then 'below' when 2 then 'above' end",
    "slide": "case suppkey % 8 when 1 then 'shift' when 2 then 'legato' when 3 then 'out_down' when 4 then 'out_up' end",
    "hopo": "partkey % 7 = 2",
    "palm_mute": "tied",
    "staccato": "linenumber = 2",
}
FX_SQL = """concat_ws(' ',
    case when q > 0 then case when qty % 2 = 0 then 'be (bendRelease 0 0 30 ' || q || ' 60 0)' else 'b (0 ' || q || ')' end end,
    case fret % 7 when 0 then 'nh' when 1 then 'ah ' || hf when 2 then 'ph ' || hf when 3 then 'th ' || hf end,
    case when partkey % 6 = 1 then 'v' end, case suppkey % 9 when 1 then 'sib' when 2 then 'sia' end,
    case suppkey % 8 when 1 then 'ss' when 2 then 'sl' when 3 then 'sod' when 4 then 'sou' end,
    case when partkey % 7 = 2 then 'h' end, case when tied then 'pm' end, case when linenumber = 2 then 'st' end)"""
FX_BASE = """fx as (select *, case when partkey % 5 = 0 then suppkey % 4 end q,
    coalesce(cast(case when fret % 2 = 0 then 5 + fret % 8 end as varchar), '12') hf from v_notes)"""


def note_effects(n):
    return nt.effects({k: F.expr(v) for k, v in EFFECTS.items()})


@register("snk5_note_effects", sql("v_notes", FX_BASE, f"select piece, pos, {FX_SQL} txt from fx"))
def _(spark, d):
    n = t.notes(spark, d)
    return n.select("piece", "pos", note_effects(n).alias("txt"))


TEX_SQL = (
    FX_BASE,
    f"fe as (select *, concat_ws(' ', case when tied then 't' end, {FX_SQL}) e from fx)",
    """nb as (select piece, measure, beat, pos, dots, tuplet, duration, cast(fret as varchar) || '.' || cast(6 - string_ as varchar)
        || case when e <> '' then '{' || e || '}' else '' end x from fe)""",
    """bt as (select piece, measure, beat, case when count(*) = 1 then min(x) else '(' || string_agg(x, ' ' order by pos) || ')' end
        || '.' || cast(min_by(duration, pos) as varchar) || case when min_by(dots, pos) > 0 or min_by(coalesce(tuplet, 0), pos) > 0 then '{' || concat_ws(' ',
          case when min_by(dots, pos) > 0 then 'd' end, case when min_by(coalesce(tuplet, 0), pos) > 0 then 'tu 3' end) || '}' else '' end x
        from nb group by all)""",
    "ms as (select piece, measure, string_agg(x, ' ' order by beat) x from bt group by all)",
    "lg as (select piece, max(measure) + piece % 2 bars from ms group by piece)",
    "al as (select piece, unnest(range(1, bars + 1)) measure from lg)",
    "select piece, measure, coalesce(x, 'r.1') line_ from al left join ms using (piece, measure)",
)


@register("snk4_text_rows", sql("v_notes", *TEX_SQL))
def _(spark, d):
    from scorelake.operators.ordered import cut_columns
    from scorelake.sources.sinks import padded_bars, text_beats

    n = t.notes(spark, d)
    n = n.withColumn("fx", F.concat_ws(" ", F.when(c("tied"), F.lit("t")), note_effects(n))).drop(*cut_columns(n))
    bars = text_beats(n, ["piece", "measure"], 6)
    return padded_bars(bars, "piece", F.expr("piece % 2"))


SONG_SQL = TEX_SQL[:5] + (
    # two tracks to a song; every ninth bar is missing, and the tracks are of different length
    """br as (select piece // 2 song, piece % 2 track, measure bar, x line_ from ms where measure % 9 > 0 or measure = 1)""",
    "tr as (select distinct piece // 2 song, piece % 2 track, count(*) over (partition by piece // 2) n from (select distinct piece from ms))",
    "mx as (select song, max(bar) bars from br group by song)",
    """fl as (select song, track, 4 section, bar, coalesce(line_, 'r.1') || case when bar < bars then ' |' else '' end line_ from (select song, track, bars, unnest(range(1, bars + 1)) bar from tr join mx using (song)) left join br using (song, track, bar))""",
    """select song, -1 track, section, 0 bar, line_ from (select distinct song, unnest([0, 1, 2]) section, unnest(['\\title "' || case when song % 3 = 0 then '' else 'Song \\"' || song || '\\"' end || '"', '\\tempo ' || case when song % 4 = 0 then 120 else 60 + song % 100 end, '.']) line_ from tr)
       union all select song, track, section, 0, line_ from (select song, track, unnest([0, 1, 2, 3]) section, unnest(['\\track "' || case when track = 0 then 'Lead' when n = 1 then 'Guitar' else 'Guitar 2' end || '"', '\\staff {tabs}',
            '\\tuning (' || case when track = 0 then 'D4 B3 G3 D3 A2 D2' else 'E4 B3 G3 D3 A2 E2' end || ')', '\\ts 4 4']) line_ from tr)
       union all select song, track, section, bar, line_ from fl""",
)


@register("snk4_song_lines", sql("v_notes", *SONG_SQL))
def _(spark, d):
    from scorelake.operators.ordered import cut_columns
    from scorelake.sources.sinks import song_lines, text_beats

    n = t.notes(spark, d)
    n = n.withColumn("fx", F.concat_ws(" ", F.when(c("tied"), F.lit("t")), note_effects(n))).drop(*cut_columns(n))
    song, track = F.expr("piece div 2").alias("song"), F.expr("piece % 2").alias("track")
    bars = text_beats(n, ["piece", "measure"], 6).where("measure % 9 > 0 or measure = 1").select(song, track, c("measure").alias("bar"), "line_")
    tracks = n.select(song, track).distinct().select(
        "song", "track", F.when(c("track") == 0, "Lead").alias("name"), F.lit(6).cast("long").alias("strings"),
        F.when(c("track") == 0, F.expr("array(38L, 45L, 50L, 55L, 59L, 62L)")).otherwise(F.expr("array(40L)")).alias("tuning"),
    )
    songs = tracks.select("song").distinct().select(
        "song", F.when(c("song") % 3 != 0, F.concat(F.lit('Song "'), c("song").cast("string"), F.lit('"'))).alias("title"),
        F.when(c("song") % 4 != 0, 60 + c("song") % 100).alias("tempo"),
    )
    return song_lines(songs, tracks, bars, "song")


@register(
    "snk1_nested_documents",
    sql(
        "v_notes",
        """bt as (select piece, measure, beat, min_by(duration, pos) duration, bool_and(partkey % 6 = 0) rest, to_json(list(
            json_object('string', string_, 'fret', fret, 'tied', tied) order by pos)) notes from v_notes group by piece, measure, beat)""",
        """bs as (select piece, measure, to_json(list(json_object('beat', beat, 'duration', duration, 'rest', rest, 'notes', notes)
            order by beat)) beats from bt group by piece, measure)""",
        "select piece, measure, cast(json_object('piece', piece, 'measure', measure, 'beats', beats) as varchar) doc from bs",
    ),
)
def _(spark, d):
    from scorelake.sources.sinks import measure_documents

    return measure_documents(t.notes(spark, d))


@register(
    "snk6_merged_parts",
    sql(
        "v_systems",
        """bars as (select piece, seq, m, row_number() over (partition by piece order by seq, m) number,
            coalesce(fifths, 0) + case when m > 1 then chars % 2 else 0 end key_ from (select *, unnest(range(1, 3 + chars % 2)) m from v_systems))""",
        """select piece, seq, m, number, case when key_ is distinct from lag(key_) over (partition by piece order by number) then key_ end key_,
            m = 1 and number > 1 new_line from bars""",
    ),
)
def _(spark, d):
    from scorelake.sources.sinks import merged_parts

    bars = t.systems(spark, d).withColumn("m", F.explode(F.expr("sequence(1L, 2L + chars % 2)")))
    bars = bars.withColumn("key_", F.expr("coalesce(fifths, 0) + case when m > 1 then chars % 2 else 0 end"))
    return merged_parts(bars.select("piece", "seq", "m", "key_"), "piece", ["seq", "m"], "key_")


@register(
    "snk7_two_staves",
    sql(
        "v_notes",
        "parts as (select piece, 1 + suppkey % 2 part, measure, pos, duration, 1 + linenumber % 4 voice from v_notes)",
        """sizes as (select piece, count(distinct case when part = 1 then measure end) a, count(distinct case when part = 2 then measure end) b
            from parts group by piece)""",
        f"""lens as (select piece, measure, cast(sum({LEN_SQL}) as bigint) len from v_notes where suppkey % 2 = 0 group by all)""",
        """select piece, measure, 1 staff, voice, pos, duration, 0::bigint backup from parts where part = 1 union all
           select p.piece, p.measure, 2, voice + 4, pos, duration, coalesce(len, 0) from parts p join sizes s using (piece)
           left join lens l on l.piece = p.piece and l.measure = p.measure where part = 2 and a = b""",
    ),
)
def _(spark, d):
    from scorelake.sources.sinks import two_staves

    n = t.notes(spark, d).select(
        "piece", F.expr("1 + suppkey % 2").alias("part"), "measure", "pos", "duration",
        F.expr("1 + linenumber % 4").alias("voice"), tk.length(c("duration"), c("dots"), c("tuplet")).alias("len"),
    )
    return two_staves(n, "piece")
