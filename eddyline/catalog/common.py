"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(column: str | Column, alias: str | None = None) -> Column:
    """A double rounded to six places, without negative zero."""
    name = alias or column
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(name)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def longs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
