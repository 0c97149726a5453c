"""Note names, tunings, staff positions, key signatures and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
STEPS = "CDEFGAB"
STEP_SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARP_ORDER = "FCGDAEB"
TUNINGS = {6: [40, 45, 50, 55, 59, 64], 7: [35, 40, 45, 50, 55, 59, 64]}
BOTTOM_LINE = STEPS.index("E") + 7 * 4


def midi_name(midi: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.concat(
        F.get(names, (midi % 12).cast("int")), (F.floor(midi / 12) - 1).cast("string")
    )


def name_midi(name: Column) -> Column:
    """Number of a note name, null when it is none or out of range."""
    from scorelake.functions.ticks import lookup

    form = r"^([A-Ga-g])(#|b)?(\d)$"
    clean = F.trim(name)
    mark = F.regexp_extract(clean, form, 2)
    shift = F.when(mark == "#", 1).when(mark == "b", -1).otherwise(0)
    base = lookup(STEP_SEMITONES, F.upper(F.regexp_extract(clean, form, 1)))
    midi = (F.regexp_extract(clean, form, 3).try_cast("int") + 1) * 12 + base + shift
    return F.when(F.regexp_like(clean, F.lit(form)) & midi.between(0, 127), midi)


def parse_tuning(text: Column, strings: Column) -> Column:
    """Numbers lowest string first; null when the count is wrong or a name is unknown."""
    parts = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda p: p != "")
    midi = F.transform(parts, name_midi)
    bad = (F.size(parts) != strings) | F.exists(midi, lambda v: v.isNull())
    return F.when(~bad, F.reverse(midi))


def tuning_text(tuning: Column) -> Column:
    return F.array_join(F.transform(F.reverse(tuning), midi_name), " ")


def default_tuning(strings: Column) -> Column:
    """The usual tuning of 6 and 7 strings; else fourths stacked down from E4, the second gap
    a major third."""
    stacked = F.transform(
        F.sequence(strings - 1, F.lit(0).cast("long"), F.lit(-1).cast("long")),
        lambda i: 64 - i * 5 + F.when(i >= 2, 1).otherwise(0),
    )
    out = F.when(strings == 6, F.array(*[F.lit(v).cast("long") for v in TUNINGS[6]]))
    out = out.when(strings == 7, F.array(*[F.lit(v).cast("long") for v in TUNINGS[7]]))
    return out.otherwise(stacked)


def staff_step(step: Column, octave: Column) -> Column:
    """Staff position, 0 for the bottom line."""
    return F.instr(F.lit(STEPS), step) - 1 + 7 * octave - BOTTOM_LINE


def position(place: Column) -> Column:
    n = place + BOTTOM_LINE
    return F.struct(
        F.substr(F.lit(STEPS), (F.pmod(n, F.lit(7)) + 1).cast("int"), F.lit(1)).alias("step"),
        F.floor(n / 7).alias("octave"),
    )


def key_alter(step: Column, fifths: Column) -> Column:
    """Sharp (1), flat (-1) or nothing (0) that a key signature sets for a step."""
    sharp = F.instr(F.lit(SHARP_ORDER), step)
    flat = 8 - sharp
    return (
        F.when((fifths > 0) & (sharp <= fifths), 1)
        .when((fifths < 0) & (flat <= -fifths), -1)
        .otherwise(0)
        .cast("long")
    )


def head_family(head: Column) -> Column:
    return F.when(head.isin("normal", "hollow"), "normal").otherwise(head)


def note_key(step: Column, octave: Column, head: Column, open_: Column) -> Column:
    place = F.concat(step, octave.cast("string"))
    return F.concat_ws(":", place, head_family(head), F.when(open_, F.lit("open")))


def valid_key(key: Column) -> Column:
    return F.regexp_like(key, F.lit(r"^[A-G][0-9]:(normal|x|circle-x)(:open)?$"))


def clock(seconds: Column) -> Column:
    """m:ss.s"""
    return F.format_string("%d:%04.1f", F.floor(seconds / 60), seconds % 60)


def quote(text: Column) -> Column:
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def track_name(index: Column, count: Column) -> Column:
    return F.when(count == 1, F.lit("Guitar")).otherwise(
        F.concat(F.lit("Guitar "), (index + 1).cast("string"))
    )


def rhythm(duration: Column, dots: Column, tuplet: Column) -> Column:
    return F.concat(
        duration.cast("string"),
        F.repeat(F.lit("."), dots.cast("int")),
        F.coalesce(F.concat(F.lit("/"), tuplet.cast("string")), F.lit("")),
    )
