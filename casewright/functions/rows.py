"""Helpers over whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later expressions use many times.

    The optimizer copies a projected expression into each of its uses; a
    generated one-row array is evaluated once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
