"""Marks, effects, events and text rows of written music."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import music as mu
from scorelake.functions.ticks import TICKS, lookup

# Fixed values.
ACCIDENTALS = {-2: "flat-flat", -1: "flat", 0: "natural", 1: "sharp", 2: "double-sharp"}
SLIDES_OUT = {1: "shift", 2: "legato", 4: "out_down", 8: "out_up"}
SLIDES_IN = {16: "below", 32: "above"}
SLIDE_OUT_TEXT = {"shift": "ss", "legato": "sl", "out_down": "sod", "out_up": "sou"}
SLIDE_IN_TEXT = {"below": "sib", "above": "sia"}
HARMONIC_TEXT = {"artificial": "ah", "pinch": "ph", "tap": "th", "semi": "sh", "feedback": "fh"}
BEND_UNIT = 50.0
PPQ = 480


def accidentals(df: DataFrame, measure: Sequence[str], order: str) -> DataFrame:
    """Which notes need an accidental: an alter other than the one in force on its step and
    octave in the measure, else the key's; not on a tied note or one that has a mark."""
    w = Window.partitionBy(*measure, "step", "octave").orderBy(order)  # inside one measure
    expected = F.coalesce(F.lag("alter_").over(w), mu.key_alter(F.col("step"), F.col("key_")))
    drawn = (F.col("alter_") != F.col("expected")) & ~F.col("tied") & ~F.col("has_mark")
    name = F.coalesce(lookup(ACCIDENTALS, F.col("alter_").cast("int")), F.lit("natural"))
    return (
        df.withColumn("expected", expected)
        .select(measure[0], order, "expected", drawn.alias("drawn"), F.when(drawn, name).alias("mark"))
    )


def bend_amount(kind: Column, digit: Column) -> Column:
    """Semitones of a bend label: a word is 2, a fraction 1 (and 2 per whole in front of it), a
    lone digit 2 each; without a label 2."""
    return (
        F.when(kind == "fraction", F.when(digit > 0, digit * 2.0 + 1).otherwise(1.0))
        .when(kind == "digit", F.when(digit > 0, digit * 2.0).otherwise(2.0))
        .otherwise(2.0)
    )


def bend_points(origin: Column, middle: Column, end: Column) -> Column:
    peak = F.greatest(origin, middle, end)
    return F.struct(
        F.when(peak > 0, peak / BEND_UNIT).alias("bend"),
        ((peak > 0) & (end < peak) & (middle >= peak)).alias("release"),
    )


def slide_flags(bits: Column) -> tuple[Column, Column]:
    def first(kinds: dict[int, str]) -> Column:
        return F.coalesce(*[F.when(bits.bitwiseAND(F.lit(k)) > 0, F.lit(v)) for k, v in kinds.items()])

    return first(SLIDES_OUT), first(SLIDES_IN)


def clamp_tempo(tempo: Column) -> Column:
    return F.greatest(F.lit(20), F.least(F.lit(400), tempo))


def quarter_micros(tempo: Column) -> Column:
    return F.call_function("div", F.lit(60_000_000), tempo)


def velocity(ghost: Column, accent: Column) -> Column:
    return F.when(ghost, 40).when(accent, 120).otherwise(96)


def quarter_ticks(ticks: Column) -> Column:
    """Whole-note ticks as 480ths of a quarter, half to even."""
    return F.bround(ticks / float(TICKS // (4 * PPQ)), 0).cast("long")


def gate(ticks: Column) -> Column:
    """A short note-off: at most a sixteenth, at least one tick."""
    return F.greatest(F.lit(1).cast("long"), quarter_ticks(F.least(ticks, F.lit(TICKS // 16))))


def effects(n: dict[str, Column]) -> Column:
    """Playing techniques of a note as text, in their fixed order; absent ones are skipped."""
    quarters = F.floor(n["bend"] * 2 + 0.5)
    q = quarters.cast("string")
    bend = F.when(
        quarters > 0,
        F.when(n["bend_release"], F.concat(F.lit("be (bendRelease 0 0 30 "), q, F.lit(" 60 0)")))
        .otherwise(F.concat(F.lit("b (0 "), q, F.lit(")"))),
    )
    harmonic = F.when(n["harmonic"] == "natural", F.lit("nh")).otherwise(
        F.concat(
            lookup(HARMONIC_TEXT, n["harmonic"]), F.lit(" "),
            F.coalesce(n["harmonic_fret"].cast("string"), F.lit("12")),
        )
    )
    return F.concat_ws(
        " ",
        bend,
        harmonic,
        F.when(n["vibrato"], F.lit("v")),
        lookup(SLIDE_IN_TEXT, n["slide_in"]),
        lookup(SLIDE_OUT_TEXT, n["slide"]),
        F.when(n["hopo"], F.lit("h")),
        F.when(n["palm_mute"], F.lit("pm")),
        F.when(n["staccato"], F.lit("st")),
    )


def beat_effects(dots: Column, tuplet: Column) -> Column:
    parts = F.concat_ws(
        " ",
        F.when(dots > 0, F.repeat(F.lit("d"), dots.cast("int"))),
        F.when(tuplet.isNotNull(), F.concat(F.lit("tu "), tuplet.cast("string"))),
    )
    return F.when(parts != "", F.concat(F.lit("{"), parts, F.lit("}"))).otherwise("")
