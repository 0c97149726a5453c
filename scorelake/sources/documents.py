"""Reading nested score documents: schema, defaults, older forms, validation, XML, joins by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators.ordered import latest, row_number, scan
from scorelake.operators.timing import nearest_fraction

c = F.col

# File name endings that are video, hosts whose links are taken.
VIDEO_EXTENSIONS = (
    ".mp4", ".mkv", ".webm", ".mov", ".avi", ".flv", ".m4v", ".ts", ".wmv", ".mpg", ".mpeg",
)
HOSTS = ("bilibili.com", "b23.tv", "youtube.com", "youtu.be")
VIDEO_ID = r"^BV[0-9A-Za-z]{10}$"
VIDEO_PAGE = "https://www.bilibili.com/video/"

NOTE = (
    "struct<string:bigint,fret:bigint,confidence:double,dead:boolean,tied:boolean,bend:double,"
    "bend_release:boolean,slide:string,slide_in:string,hopo:boolean,harmonic:string,"
    "harmonic_fret:double,vibrato:boolean,palm_mute:boolean,staccato:boolean>"
)
BEAT = (
    "struct<duration:bigint,dots:bigint,tuplet:bigint,rest:boolean,"
    f"notes:array<{NOTE}>,x:bigint,confidence:double>"
)
MEASURE = (
    "struct<number:bigint,time:array<bigint>,"
    f"beats:array<{BEAT}>,line:bigint,x0:bigint,x1:bigint,confidence:double>"
)
SCORE = (
    "struct<strings:bigint,tuning:array<bigint>,tempo:bigint,"
    f"measures:array<{MEASURE}>,title:string,name:string>"
)
SONG = f"struct<title:string,tempo:bigint,tracks:array<{SCORE}>,strings:bigint,tuning:array<bigint>,measures:array<{MEASURE}>,name:string>"


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder by name pattern, in name order; only names and sizes are read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), c("length").alias("bytes"))
        .orderBy("name")
    )


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def normal_url(text: Column, hosts: Sequence[str] = HOSTS) -> Column:
    """The link to load, null when its host is none of ``hosts`` or below one of them."""
    clean = F.trim(text)
    full = F.when(F.regexp_like(clean, F.lit("^https?://")), clean).otherwise(
        F.concat(F.lit("https://"), clean)
    )
    host = F.lower(F.regexp_extract(full, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | F.endswith(host, F.lit("." + h))
    return F.when(F.regexp_like(clean, F.lit(VIDEO_ID)), F.concat(F.lit(VIDEO_PAGE), clean)).when(known, full)


def parse_songs(df: DataFrame, text: str) -> DataFrame:
    """Parses song documents; one that holds a single score without ``tracks`` becomes a song
    of one track, its title and tempo moved up."""
    doc = F.from_json(text, SONG)
    parsed = df.withColumn("_d", doc)
    d = c("_d")
    alone = F.struct(
        d["strings"].alias("strings"), d["tuning"].alias("tuning"), F.lit(None).cast("bigint").alias("tempo"),
        d["measures"].alias("measures"), F.lit("").alias("title"),
        F.when(F.coalesce(d["name"], F.lit("")) == "", F.lit("Guitar")).otherwise(d["name"]).alias("name"),
    )
    return parsed.select(
        *[x for x in df.columns if x != text],
        F.coalesce(d["title"], F.lit("")).alias("title"),
        d["tempo"].alias("tempo"),
        F.when(d["tracks"].isNull(), F.array(alone)).otherwise(d["tracks"]).alias("tracks"),
        d["tracks"].isNull().alias("upgraded"),
    )


def flat_notes(songs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Notes of parsed songs, one row each, missing fields at their defaults. (The outer form of
    explode keeps the engine from parsing once more just to test the size of each array.)"""
    at = songs.select(*key, F.posexplode_outer("tracks").alias("track", "t"))
    at = at.select(*key, "track", F.posexplode_outer("t.measures").alias("m", "mm"))
    at = at.select(*key, "track", "m", c("mm.number").alias("number"), F.coalesce("mm.confidence", F.lit(1.0)).alias("measure_conf"), F.posexplode_outer("mm.beats").alias("b", "bb"))
    at = at.select(
        *key, "track", "m", "number", "measure_conf", "b",
        F.coalesce("bb.duration", F.lit(4)).alias("duration"), F.coalesce("bb.dots", F.lit(0)).alias("dots"),
        c("bb.tuplet").alias("tuplet"), F.posexplode_outer("bb.notes").alias("n", "nn"),
    )
    d = lambda f, v: F.coalesce(f"nn.{f}", F.lit(v)).alias(f)
    return at.where("n is not null").select(
        *key, "track", "m", "number", "measure_conf", "b", "duration", "dots", "tuplet", "n",
        d("string", 0), d("fret", 0), d("confidence", 1.0), d("dead", False), d("tied", False),
        c("nn.bend").alias("bend"),
    )


def onset_ticks(value: Column) -> Column:
    """Onset of older documents: a fraction of a whole note as text, or a number of quarters
    taken as the nearest fraction with denominator up to 96. Null when off the tick grid."""
    is_fraction = F.contains(value, F.lit("/"))
    top, bottom = F.split(value, "/")[0].try_cast("bigint"), F.split(value, "/")[1].try_cast("bigint")
    n = F.when(is_fraction, top).otherwise(F.lit(0)) * tk.TICKS
    exact = F.when(is_fraction & (n % bottom == 0), F.call_function("div", n, bottom))
    quarters = nearest_fraction(value.try_cast("double"), 96)
    m = quarters["p"] * (tk.TICKS // 4)
    near = F.when(m % quarters["q"] == 0, F.call_function("div", m, quarters["q"].cast("bigint")))
    return F.when(is_fraction, exact).otherwise(near)


def check_integer(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """Type test of one field: ``(key, value, path, reason)``, reason null for good rows. A
    truth value is not an integer; a missing field is fine."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    whole = F.schema_of_variant(v)
    bad = (
        F.when(v.isNull() | ~F.startswith(whole, F.lit("OBJECT")), F.lit("expected an object"))
        .when(kind.isNotNull() & (kind != "BIGINT"), F.lit("expected an integer"))
    )
    return df.select(
        key,
        F.when(bad.isNull(), F.try_variant_get(v, f"$.{field}", "bigint")).alias("value_"),
        F.when(bad.isNotNull(), F.when(bad == "expected an object", "").otherwise(field)).alias("path"),
        bad.alias("reason"),
    )


def track_rows(
    orders: DataFrame, items: DataFrame, parts: DataFrame, suppliers: DataFrame, nations: DataFrame
) -> DataFrame:
    """One track put together from id-referenced tables, in list order: master bars, bars,
    voices, beats and notes stand for orders, items, parts, suppliers and nations."""
    return (
        items.join(orders, "o_orderkey")
        .join(parts, "p_partkey")
        .join(suppliers, "s_suppkey")
        .join(nations, "n_nationkey")
    )


def unknown_names(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names asked for that no track has; ``only_known`` stops a job on the first one."""
    return wanted.select(name).distinct().join(known.select(name), name, "left_anti")


def only_known(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``wanted``, or an error that names a track asked for that there is not; a null name is none."""
    lost = unknown_names(wanted, known, name).first()
    if lost is not None:
        raise ValueError(f"no track {lost[0]!r}")
    return wanted


def visible_tempo(df: DataFrame, piece: str, hidden: Column, value: str, order: Sequence[str]) -> DataFrame:
    """The first visible tempo mark of a piece, else its first one."""
    return df.groupBy(piece).agg(F.min_by(value, F.struct(hidden, *order)).alias("tempo"))




def _read_measures(df: DataFrame, xml: str, schema: str) -> DataFrame:
    """``df`` with the measure ``_m`` of each text that is one. The test is made inside the generator: as a filter behind
    a projection it would move before it, and the text would be parsed once for each field that the test looks at."""
    m = F.from_xml(xml, schema, {"columnNameOfCorruptRecord": "_bad", "rowTag": "measure"})
    good = F.filter(F.array(m), lambda m: m["_bad"].isNull() & m["_number"].isNotNull())
    return df.select("*", F.explode(good).alias("_m"))


def parse_measures(df: DataFrame, xml: str) -> DataFrame:
    """Measures from XML text; text that does not parse is dropped."""
    schema = "struct<_number:bigint,note:array<struct<duration:bigint,pitch:struct<step:string,octave:bigint>>>,_bad:string>"
    parsed = _read_measures(df, xml, schema)
    keep = [x for x in df.columns if x != xml]
    return parsed.select(
        *keep, c("_m._number").alias("number"), F.size("_m.note").cast("bigint").alias("notes"),
        F.aggregate("_m.note", F.lit(0).cast("bigint"), lambda a, n: a + n["duration"]).alias("length"),
        F.array_join(F.transform("_m.note", lambda n: n["pitch"]["step"]), "").alias("steps"),
    )


CLEF = "struct<_number:bigint,sign:string,line:bigint>"
MEASURE_XML = (
    f"struct<_number:bigint,attributes:array<struct<divisions:bigint,key:struct<fifths:bigint>,time:struct<beats:bigint,`beat-type`:bigint>,clef:array<{CLEF}>>>,"
    "note:array<struct<duration:bigint,chord:struct<_x:string>,grace:struct<_x:string>,voice:bigint,pitch:struct<step:string,octave:bigint>>>,_bad:string>"
)
IN_FORCE = ("divisions", "fifths", "beats", "beat_type", "clef1", "clef2")


def measures_in_force(df: DataFrame, piece: str, order: Sequence[str], xml: str) -> DataFrame:
    """Measures from XML text in ``order``, unique in its piece, with the attributes in force: (piece, order, number, divisions, fifths, beats,
    beat_type, clef1, clef2, notes, ticks, changed).

    Text that isn't a measure is left out, and measures are numbered anew. An attribute holds until it is given again;
    ``changed`` names those that are given and differ from what is in force, the rest needn't be written. Lengths of
    notes (chords and graces add none, other voices run beside the first) are parts of a quarter that ``divisions``
    in force tells, so ``ticks`` is null where they don't come out even; divisions that never were given are 1.
    Where a measure gives an attribute more than once, the last one counts; clefs are told apart by their number."""
    given = lambda get: F.try_element_at(F.filter(F.transform("_m.attributes", get), lambda v: v.isNotNull()), F.lit(-1))
    clefs = F.flatten(F.filter(F.transform("_m.attributes", lambda a: a["clef"]), lambda v: v.isNotNull()))
    clef = lambda k: F.try_element_at(F.transform(F.filter(clefs, lambda v: F.coalesce(v["_number"], F.lit(1)) == k), lambda v: F.concat(v["sign"], F.coalesce(v["line"].cast("string"), F.lit("")))), F.lit(-1))
    own = {
        "divisions": given(lambda a: a["divisions"]), "fifths": given(lambda a: a["key"]["fifths"]), "beats": given(lambda a: a["time"]["beats"]),
        "beat_type": given(lambda a: a["time"]["beat-type"]), "clef1": clef(1), "clef2": clef(2),
    }
    sounding = F.filter("_m.note", lambda n: n["chord"].isNull() & n["grace"].isNull() & (F.coalesce(n["voice"], F.lit(1)) == 1))
    units = F.aggregate(F.coalesce(sounding, F.array()), F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n["duration"], F.lit(0)))
    rows = _read_measures(df, xml, MEASURE_XML).select(piece, *order, *(v.alias(f"_{k}") for k, v in own.items()), F.coalesce(F.size("_m.note"), F.lit(0)).cast("long").alias("notes"), units.alias("_units"))
    outs = {"number": row_number()} | {k: latest(c(f"_{k}")) for k in IN_FORCE} | {f"_was_{k}": latest(c(f"_{k}"), False) for k in IN_FORCE}
    rows = scan(rows, piece, order, outs)
    changed = F.array_compact(F.array(*[F.when(c(f"_{k}").isNotNull() & ~c(f"_{k}").eqNullSafe(c(f"_was_{k}")), k) for k in IN_FORCE]))
    whole, per = c("_units") * (tk.TICKS // 4), F.coalesce(F.when(c("divisions") > 0, c("divisions")), F.lit(1))
    ticks = F.when(whole % per == 0, F.call_function("div", whole, per))
    return rows.select(piece, *order, "number", *IN_FORCE, "notes", ticks.alias("ticks"), changed.alias("changed"))


def read_measure_files(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of XML files, one row each."""
    schema = "_number bigint, note array<struct<duration:bigint,pitch:struct<step:string,octave:bigint>>>"
    return spark.read.format("xml").option("rowTag", "measure").schema(schema).load(folder)
