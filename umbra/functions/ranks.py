"""Ranks over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.sources.staging import staged


def value_ranks(counts: DataFrame, value: str, n: str = "n", parts: int | None = None) -> DataFrame:
    """``counts`` (value, n rows of it, ...) with ``rank``: the mean of the ranks from 1 that rows of the value share.

    Values are dealt to parts by ranges; a part needs only the number of rows in the parts before it, a row for each of them.
    """
    dealt = counts.repartitionByRange(parts, value) if parts else counts.repartitionByRange(value)
    placed = staged(dealt.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum(n).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    upto = F.sum(n).over(Window.partitionBy("_part").orderBy(value))
    ranked = placed.join(F.broadcast(before), "_part").withColumn("_upto", upto)
    return ranked.withColumn("rank", F.col("_before") + F.col("_upto") - (F.col(n) - 1) / 2).drop("_part", "_before", "_upto")
