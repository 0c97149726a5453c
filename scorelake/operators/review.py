"""Confidence and review flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = 0.7


def needs_review(df: DataFrame, beat: Sequence[str]) -> DataFrame:
    """Beats to look at: a low note or beat confidence, or a measure not fully trusted."""
    return df.groupBy(*beat).agg(
        (
            F.bool_or(F.col("note_conf") < LOW)
            | F.bool_or(F.col("beat_conf") < LOW)
            | F.bool_or(F.col("measure_conf") < 1)
        ).alias("flagged")
    )


def beat_confidence(share: Column, note: Column, ok: Column) -> Column:
    """Share of the chosen reading times the weakest note, halved when the sum failed."""
    return F.bround(share * F.coalesce(note, F.lit(1.0)) * F.when(ok, 1.0).otherwise(0.5), 3)
