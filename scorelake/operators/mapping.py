"""Which drum a notehead means: presets, overrides, nearest fallback, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import music as mu

# Percussion keys with the notehead they are written with, and the presets
# (staff position and notehead family -> percussion key).
INSTRUMENTS = {
    35: ("Acoustic Bass Drum", "normal"),
    36: ("Bass Drum 1", "normal"),
    37: ("Side Stick", "x"),
    38: ("Acoustic Snare", "normal"),
    39: ("Hand Clap", "normal"),
    40: ("Electric Snare", "normal"),
    41: ("Low Floor Tom", "normal"),
    42: ("Closed Hi-Hat", "x"),
    43: ("High Floor Tom", "normal"),
    44: ("Pedal Hi-Hat", "x"),
    45: ("Low Tom", "normal"),
    46: ("Open Hi-Hat", "x"),
    47: ("Low-Mid Tom", "normal"),
    48: ("Hi-Mid Tom", "normal"),
    49: ("Crash Cymbal 1", "x"),
    50: ("High Tom", "normal"),
    51: ("Ride Cymbal 1", "x"),
    52: ("Chinese Cymbal", "x"),
    53: ("Ride Bell", "diamond"),
    54: ("Tambourine", "x"),
    55: ("Splash Cymbal", "x"),
    56: ("Cowbell", "x"),
    57: ("Crash Cymbal 2", "x"),
    59: ("Ride Cymbal 2", "x"),
}
DEFAULT = {
    "A5:x": 49,
    "A5:circle-x": 49,
    "B5:x": 57,
    "G5:x": 42,
    "G5:x:open": 46,
    "G5:circle-x": 46,
    "F5:x": 51,
    "F5:circle-x": 53,
    "E5:normal": 50,
    "D5:normal": 47,
    "C5:normal": 38,
    "C5:x": 37,
    "B4:normal": 45,
    "A4:normal": 43,
    "G4:normal": 41,
    "F4:normal": 36,
    "E4:normal": 35,
    "D4:x": 44,
}
GUITAR_PRO = {"D5:normal": 48, "B5:x": 52, "C6:x": 55, "C5:circle-x": 37}
MUSESCORE = {"D5:normal": 48, "B5:x": 57, "C6:x": 52, "E5:x": 53}
PRESETS = {"default": DEFAULT, "gp": DEFAULT | GUITAR_PRO, "musescore": DEFAULT | MUSESCORE}
CLOSED_HIHAT, OPEN_HIHAT = 42, 46


def preset(spark: SparkSession, name: str) -> DataFrame:
    """Rows ``(key, gm, ord)`` of a preset."""
    rows = [(k, gm, i) for i, (k, gm) in enumerate(PRESETS[name].items())]
    return spark.createDataFrame(rows, "key string, gm long, ord long")


def with_overrides(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """The preset with the user's own entries ``(key, gm)`` in force."""
    own = overrides.select("key", F.col("gm").alias("_own"))
    joined = table.join(own, "key", "full_outer")
    late = F.lit(1 << 20).cast("long")  # new keys come after the preset's
    return joined.select(
        "key", F.coalesce("_own", "gm").alias("gm"), F.coalesce("ord", late).alias("ord"),
        F.col("_own").isNotNull().alias("overridden"),
    )


def symbols(table: DataFrame) -> DataFrame:
    """Resolves every possible notehead once: ``(step, octave, family, open_, gm)``, 504 rows,
    whatever the size of the scores, so it can be broadcast. Keys have octaves 0 to 9; one octave more on either side
    stands for all that lie beyond, whose nearest key is the outermost."""
    spark = table.sparkSession
    parts = F.split("key", ":")
    t = table.select(
        F.substr(parts[0], F.lit(1), F.lit(1)).alias("tstep"),
        F.substr(parts[0], F.lit(2), F.lit(1)).cast("long").alias("toctave"),
        parts[1].alias("tfamily"), (F.size(parts) == 3).alias("topen"), "gm", "ord",
    )
    places = spark.range(84).select(
        F.substr(F.lit(mu.STEPS), (F.col("id") % 7 + 1).cast("int"), F.lit(1)).alias("step"),
        F.expr("id div 7 - 1").alias("octave"),
    )
    kinds = places.withColumn(
        "family", F.explode(F.array(F.lit("normal"), F.lit("x"), F.lit("circle-x")))
    ).withColumn("open_", F.explode(F.array(F.lit(False), F.lit(True))))
    here = (F.col("tstep") == F.col("step")) & (F.col("toctave") == F.col("octave"))
    family, shut = F.col("tfamily") == F.col("family"), ~F.col("topen")
    crossed = (F.col("family") == "circle-x") & (F.col("tfamily") == "x")
    same = F.when(F.col("family") == "circle-x", F.col("tfamily") == "x").otherwise(family)
    away = mu.staff_step(F.col("tstep"), F.col("toctave")) - mu.staff_step(F.col("step"), F.col("octave"))
    rank = F.struct(F.abs(away), away, F.col("ord"))
    gm = F.col("gm")
    found = kinds.join(F.broadcast(t), F.lit(True)).groupBy("step", "octave", "family", "open_").agg(
        F.max(F.when(here & family & F.col("topen") & F.col("open_"), gm)).alias("exact"),
        F.max(F.when(here & family & shut, gm)).alias("plain"),
        F.max(F.when(here & crossed & shut, gm)).alias("cross"),
        F.min_by(gm, F.when(same & shut, rank)).alias("near"),
        F.min_by(gm, F.when(shut, rank)).alias("any_"),
    )
    other = F.coalesce("plain", "cross", "near", "any_")
    return found.select(
        "step", "octave", "family", "open_",
        F.coalesce(
            "exact", F.when(F.col("open_") & (other == CLOSED_HIHAT), OPEN_HIHAT).otherwise(other)
        ).alias("gm"),
    )


def resolve(notes: DataFrame, table: DataFrame, head: str = "notehead", open_: str = "open_") -> DataFrame:
    """Adds ``gm`` to notes with ``step``, ``octave``, notehead and open mark."""
    keyed = notes.withColumn("_f", mu.head_family(F.col(head)))
    s = symbols(table).withColumnsRenamed({"step": "_s", "octave": "_o", "family": "_f", "open_": "_open"})
    octave = F.col("octave")
    keyed = keyed.withColumns({
        "_open": F.col(open_), "_o": F.when(octave < 0, -1).when(octave > 9, 10).otherwise(octave).cast("long"),
        "_s": F.when(octave < 0, "B").when(octave > 9, "C").otherwise(F.col("step")),
    })
    return keyed.join(F.broadcast(s), ["_s", "_o", "_f", "_open"], "left").drop("_s", "_o", "_f", "_open")


def usage(notes: DataFrame, table: DataFrame, piece: Sequence[str]) -> DataFrame:
    """Notes per piece and lookup key with the drum they resolve to; counted before anything
    is looked up."""
    key = mu.note_key(F.col("step"), F.col("octave"), F.col("notehead"), F.col("open_"))
    counts = (
        notes.withColumn("notehead", mu.head_family(F.col("notehead")))
        .groupBy(*piece, "step", "octave", "notehead", "open_")
        .agg(F.count("*").alias("n"))
    )
    own = table.where("overridden").select("key", F.lit(True).alias("overridden"))
    return (
        resolve(counts, table)
        .withColumn("key", key)
        .join(F.broadcast(own), "key", "left")
        .select(*piece, "key", "n", "gm", F.coalesce("overridden", F.lit(False)).alias("overridden"))
    )


def instrument(gm: Column, field: int) -> Column:
    from scorelake.functions.ticks import lookup

    return lookup({k: v[field] for k, v in INSTRUMENTS.items()}, gm.cast("int"))
