"""Numbering, repeated attributes and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ordered import previous, row_number, scan


def changed_attributes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, once: Column
) -> DataFrame:
    """Rows whose value differs from the one in force for their key; a ``once`` kind only the
    first time."""
    cols = df.columns
    seen = scan(df, keys, order, {"_p": previous(F.struct(value)), "_n": row_number()})
    emit = F.when(once, F.col("_n") == 1).otherwise(
        F.col("_p").isNull() | ~F.col("_p")[value].eqNullSafe(F.col(value))
    )
    return seen.where(emit).select(*cols)
