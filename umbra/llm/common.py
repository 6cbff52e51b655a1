"""What several training-data operators share: staging, skew-safe joins, words and subword ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources.staging import staged

__all__ = ["WHITE_SPACE", "Cache", "arrow_batches", "crc_bucket", "join_by_group", "slices", "staged", "table", "text_of", "union_all", "without"]

#: ASCII white space, the characters of ``[\x20\x09-\x0D]``.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_groups: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` in ``groups`` that survives hot keys.

    ``size`` is the column of ``groups`` with the number of rows of that key and ``total`` their sum.
    A key with over ``total / hot_groups`` rows is hot: there are fewer than ``hot_groups`` of them, so
    that side may be broadcast and its rows stay where they are. All other keys are shuffled.
    """
    limit = max(total // hot_groups, 100)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(
        rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti").join(cold, key)
    )


def without(rows: DataFrame, dropped: DataFrame, keys: list[str], broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows whose keys (null-safe) are not in the staged table ``dropped``, all columns kept.

    Up to ``broadcast_rows`` keys the rows stay where they are; beyond it they are shuffled.
    """
    small = dropped.count() <= broadcast_rows
    gone = dropped.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    same = [rows[k].eqNullSafe(gone[f"_gone_{k}"]) for k in keys]
    return rows.join(F.broadcast(gone) if small else gone, same, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32(column as text) mod buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Tables staged inside go to Python in batches of at most ``rows`` rows and about ``size`` bytes; long texts then take no more memory than short ones.

    Parquet is read 512 rows at a time, as a reader's arrays have room for that many long values.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b",
        "spark.sql.parquet.columnarReaderBatchSize": "512",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Cache(dict):
    """``make(key)`` remembered. With ``limit`` keys they become the old generation, and the one before is
    forgotten: what is used again moves on, and a worker's memory stays bounded."""

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
