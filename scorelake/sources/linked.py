"""Tracks of documents whose parts refer to each other by id, as lists of ids in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.session import checkpoint_folder

c = F.col

# Fixed values of the format: names of note values, flags of slides out of and into a note, names of harmonics, bend
# units of a semitone, the flag of a staccato among accents.
NOTE_VALUES = {"Whole": 1, "Half": 2, "Quarter": 4, "Eighth": 8, "16th": 16, "32nd": 32, "64th": 64}
SLIDES_OUT = {1: "shift", 2: "legato", 4: "out_down", 8: "out_up"}
SLIDES_IN = {16: "below", 32: "above"}
HARMONICS = ("natural", "artificial", "pinch", "tap", "semi", "feedback")
BEND_UNIT = 50.0
STACCATO = 1

PROPERTY = "struct<_name:string,String:string,Fret:string,Float:string,Flags:string,HType:string,HFret:string,Number:string,Pitches:string,_VALUE:string>"
TRACKS = f"""
    MasterTrack:struct<Automations:struct<Automation:array<struct<Type:string,Visible:string,Value:string>>>>,
    Tracks:struct<Track:array<struct<Name:string,Properties:struct<Property:array<{PROPERTY}>>>>>"""
# What tells of the tracks alone; the whole text must still be a document, but no element of the id tables is made.
HEAD = f"struct<{TRACKS},MasterBars:struct<_id:string>,_bad:string>"
DOCUMENT = f"""struct<{TRACKS},
    MasterBars:struct<MasterBar:array<struct<Time:string,Bars:string>>>,
    Bars:struct<Bar:array<struct<_id:string,Voices:string>>>,
    Voices:struct<Voice:array<struct<_id:string,Beats:string>>>,
    Beats:struct<Beat:array<struct<_id:string,Rhythm:struct<_ref:string>,Notes:string>>>,
    Notes:struct<Note:array<struct<_id:string,Tie:struct<_destination:string>,Vibrato:string,Accent:string,Properties:struct<Property:array<{PROPERTY}>>>>>,
    Rhythms:struct<Rhythm:array<struct<_id:string,NoteValue:string,AugmentationDot:struct<_count:string>,PrimaryTuplet:struct<_num:string>>>>,
    _bad:string>"""


def ids(text: Column) -> Column:
    """The ids of a list, in order."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def named(properties: Column, name: str) -> Column:
    """The text of the last property of this name; an empty one where it has none; null without the property."""
    found = F.filter(F.coalesce(properties, F.array()), lambda p: p["_name"] == name)
    fields = ("String", "Fret", "Float", "Flags", "HType", "HFret", "Number", "Pitches", "_VALUE")
    return F.try_element_at(F.transform(found, lambda p: F.trim(F.coalesce(*(p[f] for f in fields), F.lit("")))), F.lit(-1))


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def _read(df: DataFrame, text: str, schema: str) -> DataFrame:
    doc = F.from_xml(text, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"})
    found = df.withColumn("doc", doc).withColumn("doc", F.when(c("doc._bad").isNull() & c("doc.MasterBars").isNotNull(), c("doc")))
    return found.drop(text)


def parsed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its XML ``text`` parsed once into ``doc``; documents that don't parse have a null. Kept as a
    checkpoint, as seven tables are made of it."""
    checkpoint_folder(df.sparkSession)
    return _read(df, text, DOCUMENT).checkpoint()


def part(docs: DataFrame, key: Sequence[str], path: str, *columns: Column) -> DataFrame:
    """One row per element of a list in the documents: (key, at, columns of the element ``e``)."""
    return docs.select(*key, F.posexplode(f"doc.{path}").alias("at", "e")).select(*key, c("at"), *columns)


def _place(name: str) -> Column:
    return (F.array_position(F.transform("doc.Tracks.Track", lambda t: t["Name"]), name) - 1).cast("int")


def _head(place: Column) -> dict[str, Column]:
    marks = F.filter("doc.MasterTrack.Automations.Automation", lambda a: a["Type"] == "Tempo")
    shown = F.filter(marks, lambda a: ~a["Visible"].eqNullSafe("false"))
    mark = F.get(F.when(F.size(shown) > 0, shown).otherwise(marks), F.lit(0))["Value"]
    pitches = named(F.get("doc.Tracks.Track", place)["Properties"]["Property"], "Tuning")
    tuning = F.transform(ids(pitches), lambda x: x.cast("bigint"))
    tempo = F.floor(number(F.get(F.split(mark, " "), F.lit(0))))
    return {"tuning": tuning, "strings": F.size(tuning).cast("bigint"), "tempo": F.when(mark.isNotNull(), tempo)}


def _lost(name: str) -> Column:
    """Why a document has no such track; null where it has one."""
    names = F.coalesce(F.transform("doc.Tracks.Track", lambda t: t["Name"]), F.array().cast("array<string>"))
    lacks = F.concat(F.lit(f"no track {name!r} in "), F.array_join(names, ", "))
    return F.when(c("doc").isNull(), "not a document").when(~F.coalesce(F.array_contains(names, name), F.lit(False)), lacks)


def tracks(docs: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """(key, place, tuning, strings, tempo) of the first track of this name in each document that has one.

    The tempo is that of the first visible mark, else of the first mark."""
    found = docs.withColumn("place", _place(name)).where("place >= 0")
    return found.select(*key, "place", *(v.alias(k) for k, v in _head(c("place")).items()))


def without_track(docs: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """(key, reason) of the documents that have no such track, or don't parse."""
    return docs.select(*key, _lost(name).alias("reason")).where(c("reason").isNotNull())


def heads(df: DataFrame, key: Sequence[str], text: str, name: str) -> DataFrame:
    """(key, tuning, strings, tempo, reason): ``tracks`` and ``without_track`` of XML texts as one row for each, in one pass
    that makes no element of the id tables and keeps nothing."""
    docs = _read(df, text, HEAD).withColumns({"place": _place(name), "reason": _lost(name)})
    return docs.select(*key, *(F.when(c("place") >= 0, v).alias(k) for k, v in _head(c("place")).items()), "reason")


def flag(value: Column, names: dict[int, str]) -> Column:
    """The name of the first flag that is set."""
    return F.coalesce(*(F.when(value.bitwiseAND(bit) != 0, name) for bit, name in names.items()))


def note_fields() -> list[Column]:
    """String, fret and techniques of a note element ``e``."""
    p = lambda name: named(c("e.Properties.Property"), name)
    points = [number(p(f"Bend{k}Value")) for k in ("Origin", "Middle", "Destination")]
    peak, slide = F.greatest(*points), number(p("Slide")).cast("bigint")
    bent = p("Bended").isNotNull() & (peak > 0)
    kind = F.lower(p("HarmonicType"))
    known = kind.isin(*HARMONICS)
    return [
        p("String").cast("bigint").alias("string"), p("Fret").cast("bigint").alias("fret"),
        p("Muted").isNotNull().alias("dead"), (F.lower(F.coalesce("e.Tie._destination", F.lit(""))) == "true").alias("tied"),
        F.when(bent, peak / BEND_UNIT).alias("bend"), F.coalesce(bent & (points[2] < peak) & (points[1] >= peak), F.lit(False)).alias("bend_release"),
        flag(slide, SLIDES_OUT).alias("slide"), flag(slide, SLIDES_IN).alias("slide_in"), p("HopoOrigin").isNotNull().alias("hopo"),
        F.when(known, kind).alias("harmonic"), F.when(known, number(p("HarmonicFret"))).alias("harmonic_fret"),
        p("PalmMuted").isNotNull().alias("palm_mute"), c("e.Vibrato").isNotNull().alias("vibrato"),
        F.coalesce(c("e.Accent").try_cast("bigint").bitwiseAND(STACCATO) != 0, F.lit(False)).alias("staccato"),
    ]


def track_rows(docs: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """The notes of one track of each document, in list order: (key, measure, num, den, beat, duration, dots,
    tuplet, rest, listed, string, fret, techniques). A beat without notes, and a measure without beats, is one row.

    Each level is an equi-join on (key, id) of ids that the level above lists: master bars name a bar for each track,
    a bar names voices, of which the first that is not "-1" counts, a voice names beats, a beat names a rhythm and notes.
    ``measure``, ``beat`` and ``listed`` are the places in these lists, so the order is kept without a sort. Ids may be used many times. An id that nothing has is no row below it."""
    key = list(key)
    bars = part(docs, key, "Bars.Bar", c("e._id").alias("bar"), F.get(F.filter(ids(c("e.Voices")), lambda v: v != "-1"), F.lit(0)).alias("voice"))
    voices = part(docs, key, "Voices.Voice", c("e._id").alias("voice"), ids(c("e.Beats")).alias("beats"))
    dots, tuplet = F.coalesce(c("e.AugmentationDot._count").try_cast("bigint"), F.lit(0)), c("e.PrimaryTuplet._num").try_cast("bigint")
    value = F.create_map(*[F.lit(x) for kv in NOTE_VALUES.items() for x in kv])
    rhythms = part(docs, key, "Rhythms.Rhythm", c("e._id").alias("rhythm"), F.coalesce(F.try_element_at(value, F.coalesce("e.NoteValue", F.lit("Quarter"))), F.lit(4)).cast("bigint").alias("duration"), dots.alias("dots"), tuplet.alias("tuplet"))
    beats = part(docs, key, "Beats.Beat", c("e._id").alias("beat_id"), c("e.Rhythm._ref").alias("rhythm"), ids(c("e.Notes")).alias("notes"))
    notes = part(docs, key, "Notes.Note", c("e._id").alias("note_id"), *note_fields())
    signature = F.split(F.coalesce("e.Time", F.lit("4/4")), "/")
    master = part(docs, key, "MasterBars.MasterBar", signature[0].try_cast("bigint").alias("num"), signature[1].try_cast("bigint").alias("den"), ids(c("e.Bars")).alias("bars"))
    master = master.join(tracks(docs, key, name).select(*key, "place"), key)
    master = master.select(*key, (c("at") + 1).cast("bigint").alias("measure"), "num", "den", F.get("bars", c("place")).alias("bar"))

    found = master.join(bars.drop("at"), [*key, "bar"], "left").join(voices.drop("at"), [*key, "voice"], "left")
    found = found.select(*key, "measure", "num", "den", F.posexplode_outer("beats").alias("beat", "beat_id"))
    found = found.join(beats.drop("at"), [*key, "beat_id"], "left").join(rhythms.drop("at"), [*key, "rhythm"], "left")
    found = found.select(*key, "measure", "num", "den", (c("beat") + 1).cast("bigint").alias("beat"), "duration", "dots", "tuplet", F.when(c("beat").isNotNull(), F.size("notes") <= 0).alias("rest"), F.posexplode_outer("notes").alias("listed", "note_id"))
    found = found.join(notes.drop("at"), [*key, "note_id"], "left")
    return found.drop("note_id", "rhythm", "voice", "bar")
