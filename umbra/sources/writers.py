"""Writers: sorted Parquet for further work, CSV and JSON for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_parquet(df: DataFrame, path: str, by: Sequence[str], partition: Sequence[str] = ()) -> None:
    """Range-partitioned and sorted within files, so that later scans skip row groups; zstd."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt.write.partitionBy(*partition).option("compression", "zstd").mode("overwrite").parquet(path)


def report_csv(df: DataFrame, path: str, digits: int = 3) -> None:
    """A result table as one CSV file with doubles rounded for the reader; for tables of few rows."""
    plain = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    plain.coalesce(1).write.mode("overwrite").csv(path, header=True)


def summary_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
