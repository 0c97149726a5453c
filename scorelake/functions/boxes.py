"""Boxes: clamping, overlap, shape, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """The box moved and cut into a ``width`` by ``height`` frame, at least one pixel big."""
    cx = F.least(F.greatest(x, F.lit(0)), F.lit(width - 1))
    cy = F.least(F.greatest(y, F.lit(0)), F.lit(height - 1))
    return F.struct(
        cx.alias("x"),
        cy.alias("y"),
        F.greatest(F.lit(1), F.least(w, width - cx)).alias("w"),
        F.greatest(F.lit(1), F.least(h, height - cy)).alias("h"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two ``x, y, w, h`` structs, 0 when the union is empty."""

    def side(o: str, n: str) -> Column:
        return F.greatest(
            F.lit(0), F.least(a[o] + a[n], b[o] + b[n]) - F.greatest(a[o], b[o])
        )

    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def shape_features(w: Column, h: Column, ink: Column, space: float) -> Column:
    """Height and width in staff spaces, log of their ratio, share of ink."""
    return F.struct(
        (h / F.lit(space)).alias("hs"),
        (w / F.lit(space)).alias("ws"),
        F.ln(w / h).alias("ratio"),
        (ink / (w * h)).alias("fill"),
    )


# Columns of an 8 by 8 bitmap, as bit masks of a 64-bit word (bit = row * 8 + column).
def _without_columns(first: int, last: int) -> int:
    mask = sum(1 << (r * 8 + c) for r in range(8) for c in range(8) if not first <= c <= last)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bitmap(values: Column, level: float) -> Column:
    """The 64 values above ``level`` as one word."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda m, i: F.when(
            F.get(values, i) > level,
            m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        ).otherwise(m),
    )


def dilate(m: Column) -> Column:
    """Ink grown by two cells in every direction (a 5 by 5 box)."""
    wide = m
    for n in (1, 2):
        right = F.shiftleft(m, n).bitwiseAND(F.lit(_without_columns(0, n - 1)))
        left = F.shiftrightunsigned(m, n).bitwiseAND(F.lit(_without_columns(8 - n, 7)))
        wide = wide.bitwiseOR(right).bitwiseOR(left)
    tall = wide
    for n in (8, 16):
        tall = tall.bitwiseOR(F.shiftleft(wide, n)).bitwiseOR(F.shiftrightunsigned(wide, n))
    return tall


def mismatch(a: Column, b: Column) -> Column:
    """Share of either bitmap's ink without ink of the other nearby; 1 when both are blank."""
    total = F.bit_count(a) + F.bit_count(b)
    miss = F.bit_count(a.bitwiseAND(F.bitwise_not(dilate(b)))) + F.bit_count(
        b.bitwiseAND(F.bitwise_not(dilate(a)))
    )
    return F.when(total == 0, F.lit(1.0)).otherwise(miss / total)
