"""Exact note lengths as whole ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticks of a whole note (exact for values 1..64, up to two dots and the tuplets
# below), how many notes of normal length a tuplet takes, note values and their names.
TICKS = 80640
TICK_PRIMES = {2: 8, 3: 2, 5: 1, 7: 1}
TUPLETS = {3: 2, 5: 4, 6: 4, 7: 4, 9: 8}
VALUES = (1, 2, 4, 8, 16, 32, 64)
VALUE_NAMES = {1: "whole", 2: "half", 4: "quarter", 8: "eighth", 16: "16th", 32: "32nd", 64: "64th"}


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is not in it."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, key)


def normal_notes(tuplet: Column) -> Column:
    return F.coalesce(lookup(TUPLETS, tuplet.cast("int")).cast("long"), tuplet)


def length(duration: Column, dots: Column, tuplet: Column) -> Column:
    """Ticks of a note value with dots, inside a tuplet if there is one."""
    one = F.lit(1).cast("long")
    dot = F.call_function("shiftleft", one, dots.cast("int"))
    top = F.lit(TICKS).cast("long") * (dot * 2 - 1) * F.coalesce(normal_notes(tuplet), one)
    return F.call_function("div", top, duration * dot * F.coalesce(tuplet, one))


def plain(value: int, dots: int) -> int:
    return TICKS * (2 ** (dots + 1) - 1) // (value * 2**dots)


def spell(ticks: Column) -> Column:
    """``(value, dots)`` with exactly this length, else null."""
    spelled = {plain(v, k): (v, k) for v in VALUES for k in (0, 1, 2)}
    value = lookup({n: v for n, (v, _) in spelled.items()}, ticks.cast("int"))
    dots = lookup({n: k for n, (_, k) in spelled.items()}, ticks.cast("int"))
    return F.struct(value.cast("long").alias("value"), dots.cast("long").alias("dots"))


def largest_fitting(room: Column) -> Column:
    """``(value, dots, ticks)`` of the longest value with at most one dot that fits, else a 64th."""
    fits = sorted(((plain(v, k), v, k) for v in VALUES for k in (0, 1)), reverse=True)

    def row(n: int, v: int, k: int) -> Column:
        return F.struct(
            F.lit(v).cast("long").alias("value"),
            F.lit(k).cast("long").alias("dots"),
            F.lit(n).cast("long").alias("ticks"),
        )

    return F.coalesce(
        *[F.when(room >= n, row(n, v, k)) for n, v, k in fits], row(plain(64, 0), 64, 0)
    )


def capacity(num: Column, den: Column) -> Column:
    return F.call_function("div", num * F.lit(TICKS).cast("long"), den)


def beat_ticks(num: Column, den: Column) -> Column:
    """Beat of a time signature: a dotted quarter in compound eighths, else one lower value."""
    compound = (den == 8) & (num % 3 == 0) & (num > 3)
    return F.when(compound, F.lit(TICKS * 3 // 8).cast("long")).otherwise(
        F.call_function("div", F.lit(TICKS).cast("long"), den)
    )
