"""Written forms as rows. A document is its rows in order (one per measure, never one per
piece), so a long piece is written by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import music as mu
from scorelake.functions import ticks as tk
from scorelake.operators import notation as nt
from scorelake.operators.mapping import OPEN_HIHAT, instrument
from scorelake.operators.ordered import previous, row_number, scan

c = F.col
XML_TICKS = 12  # our ticks per written division (1680 per quarter)


def _el(name: str, *body) -> Column:
    parts = [b if isinstance(b, Column) else F.lit(b) for b in body]
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name.split(' ')[0]}>"))


def _num(col: Column) -> Column:
    return col.cast("string")


def _div(col: Column) -> Column:
    return _num(F.call_function("div", col, F.lit(XML_TICKS).cast("long")))


def note_xml() -> Column:
    """One written note: length, instrument, voice, type, dots, tuplet, stem, head, beams, marks."""
    rest, none = c("rest"), F.lit("")
    body = F.when(rest, F.concat(F.lit("<rest/>"), _el("duration", _div(c("length"))))).otherwise(
        F.concat(
            _el("unpitched", _el("display-step", c("step")), _el("display-octave", _num(c("octave")))),
            _el("duration", _div(c("length"))),
            F.lit('<instrument id="P1-I'), _num(c("gm")), F.lit('"/>'),
        )
    )
    tuplet = F.when(
        c("tuplet").isNotNull(),
        _el("time-modification", _el("actual-notes", _num(c("tuplet"))), _el("normal-notes", _num(tk.normal_notes(c("tuplet"))))),
    ).otherwise(none)
    shape = instrument(c("gm"), 1)
    head = F.when(
        (shape != "normal") | c("ghost"),
        F.concat(F.lit("<notehead"), F.when(c("ghost"), ' parentheses="yes"').otherwise(none), F.lit(">"), shape, F.lit("</notehead>")),
    ).otherwise(none)
    opened = c("open_") | (c("gm") == OPEN_HIHAT)
    marks = F.when(
        opened | c("accent"),
        _el(
            "notations",
            F.when(opened, "<technical><open-string/></technical>").otherwise(none),
            F.when(c("accent"), "<articulations><accent/></articulations>").otherwise(none),
        ),
    ).otherwise(none)
    stem = _el("stem", F.when(c("voice") == 1, "up").otherwise("down"))
    return _el(
        "note", body, _el("voice", _num(c("voice"))),
        _el("type", tk.lookup(tk.VALUE_NAMES, c("duration").cast("int"))),
        F.repeat(F.lit("<dot/>"), c("dots").cast("int")), tuplet,
        F.when(rest, none).otherwise(F.concat(stem, head, F.coalesce("beams", none), marks)),
    )


def measure_parts(beats: DataFrame, room: str) -> DataFrame:
    """(piece, measure, room, ``1``, ``2``): the written notes and gaps of both voices in time order, from placed beats
    with ``gm``, ``beams`` and ``gaps``; a beat without ``pos`` tells of its measure alone."""
    forward = lambda g: F.struct(
        g["start"].alias("start"), _el("forward", _el("duration", _div(g["length"])), _el("voice", _num(c("voice")))).alias("x")
    )
    beam = lambda b: F.concat(F.lit('<beam number="'), b["level"].cast("string"), F.lit('">'), b["kind"], F.lit("</beam>"))
    beats = beats.withColumn("beams", F.array_join(F.transform("beams", beam), ""))
    beats = beats.withColumn("_parts", F.when(c("pos").isNotNull(), F.concat(F.array(F.struct("start", note_xml().alias("x"))), F.transform("gaps", forward))))
    # one measure holds a handful of notes
    texts = lambda v: F.array_join(
        F.transform(F.array_sort(F.flatten(F.collect_list(F.when(c("voice") == v, c("_parts"))))), lambda p: p["x"]), ""
    )
    return beats.groupBy("piece", "measure").agg(F.max(room).alias(room), *(texts(v).alias(str(v)) for v in (1, 2)))


def measure_xml(measures: DataFrame) -> DataFrame:
    """A measure per row: attributes only when they change, the second voice after a backup, a
    whole-measure rest where the first voice is empty."""
    first, changed = c("measure") == 1, c("before") != c("cap")
    none = F.lit("")
    time = _el("time", _el("beats", _num(F.call_function("div", c("cap"), F.lit(tk.TICKS // 4).cast("long")))), _el("beat-type", "4"))
    attrs = F.when(
        first | changed,
        _el(
            "attributes",
            F.when(first, "<divisions>1680</divisions><key><fifths>0</fifths></key>").otherwise(none),
            time,
            F.when(
                first,
                "<clef><sign>percussion</sign></clef><staff-details><staff-lines>5</staff-lines></staff-details>",
            ).otherwise(none),
        ),
    ).otherwise(none)
    length = _el("duration", _div(c("cap")))
    empty = F.concat(F.lit('<note><rest measure="yes"/>'), length, F.lit("<voice>1</voice></note>"))
    one = F.when(F.coalesce(c("1"), none) == "", empty).otherwise(c("1"))
    two = F.when(F.coalesce(c("2"), none) == "", none).otherwise(F.concat(_el("backup", length), c("2")))
    xml = F.concat(F.lit('<measure number="'), _num(c("measure")), F.lit('">'), attrs, one, two, F.lit("</measure>"))
    return measures.select("piece", "measure", xml.alias("xml"))


def event_rows(bars: DataFrame, notes: DataFrame, tempo: Column) -> DataFrame:
    """Timeline rows ``(tick, ord, kind, key_, velocity)``: tempo once, meter when it changes,
    note on and off."""
    rows = ["piece", "tick", "ord", "kind", "key_", "velocity"]
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    start = nt.quarter_ticks(c("start_tick"))
    hits = notes.where(~c("rest")).join(bars.select("piece", "measure", "start_tick"), ["piece", "measure"])
    on = start + nt.quarter_ticks(c("start"))
    off = on + nt.gate(c("length"))
    pair = F.array(
        F.struct(on.alias("tick"), as_int(2).alias("ord"), F.lit("on").alias("kind"), as_int(nt.velocity(c("ghost"), c("accent"))).alias("velocity")),
        F.struct(off.alias("tick"), as_int(1).alias("ord"), F.lit("off").alias("kind"), as_int(0).alias("velocity")),
    )
    notes_out = hits.select("piece", F.explode(pair).alias("e"), c("gm").alias("key_")).select(
        "piece", "e.tick", "e.ord", "e.kind", "key_", "e.velocity"
    )
    meter = bars.where(~c("before").eqNullSafe(c("cap"))).select(
        "piece", start.alias("tick"), as_int(2).alias("ord"), F.lit("meter").alias("kind"),
        F.call_function("div", c("cap"), F.lit(tk.TICKS // 4).cast("long")).alias("key_"), as_int(4).alias("velocity"),
    )
    speed = bars.select("piece").distinct().select(
        "piece", F.lit(0).cast("long").alias("tick"), as_int(1).alias("ord"), F.lit("tempo").alias("kind"),
        nt.quarter_micros(nt.clamp_tempo(tempo)).cast("long").alias("key_"), as_int(0).alias("velocity"),
    )
    return notes_out.select(*rows).unionByName(meter.select(*rows)).unionByName(speed.select(*rows))


def text_beats(notes: DataFrame, measure: Sequence[str], strings: int) -> DataFrame:
    """A measure per row as text: beats of ``fret.string{effects}``, chords in brackets."""
    fx = F.when(c("fx") != "", F.concat(F.lit("{"), c("fx"), F.lit("}"))).otherwise("")
    note = F.concat(_num(c("fret")), F.lit("."), _num(strings - c("string_")), fx)
    beats = notes.withColumn("_x", note).groupBy(*measure, "beat").agg(
        F.array_sort(F.collect_list(F.struct("pos", "_x", "duration", "dots", "tuplet"))).alias("n")
    )
    first = F.get("n", F.lit(0))
    names = F.array_join(F.transform("n", lambda x: x["_x"]), " ")
    body = F.when(F.size("n") == 1, names).otherwise(F.concat(F.lit("("), names, F.lit(")")))
    text = F.concat(body, F.lit("."), _num(first["duration"]), nt.beat_effects(first["dots"], first["tuplet"]))
    return beats.withColumn("_t", text).groupBy(*measure).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beat", "_t"))), lambda b: b["_t"]), " ").alias("line_")
    )


def padded_bars(bars: DataFrame, piece: str, more: Column) -> DataFrame:
    """Fills a track up with rest bars to the length of the longest one."""
    last = bars.groupBy(piece).agg(F.max("measure").alias("_n")).withColumn("_all", c("_n") + more)
    extra = last.where("_all > _n").select(
        piece, F.explode(F.sequence(c("_n") + 1, c("_all"))).alias("measure"), F.lit("r.1").alias("line_")
    )
    return bars.unionByName(extra)


REST_BAR = "r.1"


def song_lines(songs: DataFrame, tracks: DataFrame, bars: DataFrame, piece: str) -> DataFrame:
    """(piece, track, section, bar, line_): a song as lines of text, in order of these columns.

    ``songs`` (piece, title, tempo), ``tracks`` (piece, track from 0, name, strings, tuning from the lowest string) and ``bars``
    (piece, track, bar from 1, line_). Every track has as many bars as the longest one of its song: a bar that it lacks
    is a rest. Titles and tempos that are missing are empty and 120; tracks without a name are numbered; a tuning
    that isn't as long as the strings is the usual one. Bars of tracks that aren't listed are left out."""
    count = tracks.groupBy(piece).agg(F.count("*").alias("_count"))
    longest = bars.join(tracks.select(piece, "track"), [piece, "track"], "left_semi").groupBy(piece).agg(F.max("bar").alias("_bars"))
    at = lambda section, line: F.struct(F.lit(section).alias("section"), F.lit(0).cast("long").alias("bar"), line.alias("line_"))
    title, tempo = mu.quote(F.coalesce("title", F.lit(""))), F.coalesce(F.when(c("tempo") != 0, c("tempo")), F.lit(120))
    head = songs.select(piece, F.lit(-1).cast("long").alias("track"), F.inline(F.array(
        at(0, F.concat(F.lit("\\title "), title)), at(1, F.concat(F.lit("\\tempo "), _num(tempo))), at(2, F.lit(".")),
    )))
    one = tracks.join(count, piece).join(longest, piece, "left")
    name = mu.quote(F.when(F.coalesce("name", F.lit("")) != "", c("name")).otherwise(mu.track_name(c("track"), c("_count"))))
    strings = F.when(F.size("tuning") == c("strings"), c("tuning")).otherwise(mu.default_tuning(c("strings")))
    tuned = F.array_join(F.transform(F.reverse(strings), mu.midi_name), " ")
    opening = one.select(piece, "track", F.inline(F.array(
        at(0, F.concat(F.lit("\\track "), name)), at(1, F.lit("\\staff {tabs}")), at(2, F.concat(F.lit("\\tuning ("), tuned, F.lit(")"))), at(3, F.lit("\\ts 4 4")),
    )))
    every = one.where("_bars > 0").select(piece, "track", "_bars", F.explode(F.sequence(F.lit(1).cast("long"), c("_bars"))).alias("bar"))
    filled = every.join(bars.select(piece, "track", "bar", "line_"), [piece, "track", "bar"], "left")
    text = F.concat(F.coalesce("line_", F.lit(REST_BAR)), F.when(c("bar") < c("_bars"), " |").otherwise(""))
    return head.unionByName(opening).unionByName(filled.select(piece, "track", F.lit(4).alias("section"), "bar", text.alias("line_")))


def measure_documents(notes: DataFrame) -> DataFrame:
    """One JSON document per measure with beats and notes nested in order."""
    note = F.struct(
        "pos", F.struct(c("string_").alias("string"), "fret", "tied").alias("n")
    )
    beats = notes.groupBy("piece", "measure", "beat").agg(
        F.min_by("duration", "pos").alias("duration"),
        F.bool_and(F.expr("partkey % 6 = 0")).alias("rest"),
        F.transform(F.array_sort(F.collect_list(note)), lambda x: x["n"]).alias("notes"),
    )
    nested = beats.groupBy("piece", "measure").agg(
        F.array_sort(F.collect_list(F.struct("beat", "duration", "rest", "notes"))).alias("beats")
    )
    return nested.select("piece", "measure", F.to_json(F.struct("piece", "measure", "beats")).alias("doc"))


def merged_parts(bars: DataFrame, piece: str, order: Sequence[str], value: str) -> DataFrame:
    """Parts joined in order: measures numbered through, an attribute written only when it
    changes, a new line at the first measure of every later part."""
    out = scan(bars, piece, order, {"number": row_number(), "_p": previous(c(value))})
    return out.select(
        piece, *order, "number",
        F.when(~c("_p").eqNullSafe(c(value)), c(value)).alias(value),
        ((c(order[-1]) == 1) & (c("number") > 1)).alias("new_line"),
    )


def two_staves(parts: DataFrame, piece: str) -> DataFrame:
    """Two parts with equally many measures become one on two staves: the lower one is staff 2
    with voices shifted by 4, after a backup over the upper part. Otherwise the first alone."""
    upper, lower = parts.where("part = 1"), parts.where("part = 2")
    equal = parts.groupBy(piece).agg(
        F.count_distinct(F.when(c("part") == 1, c("measure"))).alias("a"),
        F.count_distinct(F.when(c("part") == 2, c("measure"))).alias("b"),
    ).where("a = b").select(piece)
    back = upper.groupBy(piece, "measure").agg(F.sum("len").alias("backup"))
    keep = [piece, "measure", "staff", "voice", "pos", "duration", "backup"]
    top = upper.withColumns({"staff": F.lit(1), "backup": F.lit(0).cast("long")}).select(*keep)
    low = lower.join(equal, piece, "left_semi").join(back, [piece, "measure"], "left").select(
        piece, "measure", F.lit(2).alias("staff"), (c("voice") + 4).alias("voice"), "pos", "duration",
        F.coalesce("backup", F.lit(0)).alias("backup"),
    )
    return top.unionByName(low)


def write_documents(rows: DataFrame, piece: str, order: str, text: str, folder: str) -> None:
    """Writes text rows sorted by piece and order: the files in name order hold every document
    line by line, however long one is."""
    rows.repartitionByRange(piece, order).sortWithinPartitions(piece, order).select(
        piece, order, text
    ).write.mode("overwrite").json(folder)
