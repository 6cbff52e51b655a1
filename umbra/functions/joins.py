"""Joins with sides that are small as a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.sources.staging import staged


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` for the small side of a join: written once, counted, and broadcast up to ``most`` rows; beyond it Spark plans the join by sizes."""
    kept = staged(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides, whatever size the planner takes it for: that goes by the bytes of a file, and rows out of arrays or cross joins may be a
    thousand times as many as the file holds."""
    return df.hint("merge")
