"""Audits of published tables and figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.joins import small


def claims_in_texts(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """How many texts hold each claim literally, white space aside; claims (claim, rendered) are a small table."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    packed = texts.select(bare(F.col("text")).alias("packed"))
    found = packed.join(small(claims.select("claim", bare(F.col("rendered")).alias("needle"))), F.contains("packed", F.col("needle"))).groupBy("claim").agg(F.count("*").alias("texts"))
    return claims.select("claim").join(found, "claim", "left").select("claim", F.coalesce("texts", F.lit(0)).alias("texts"))


def compared(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """Per column: rows on either side alone and rows off by more than atol + rtol * |stored|."""
    was = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    rows = recomputed.withColumn("_here", F.lit(True)).join(was, list(keys), "full_outer")
    off = lambda c: F.count_if(F.abs(F.col(c) - F.col(f"_{c}")) > atol + rtol * F.abs(F.col(f"_{c}")))
    alone = F.count_if(F.col("_here").isNull() | F.col("_there").isNull())
    return rows.agg(F.count("*").alias("rows"), alone.alias("alone"), *[off(c).alias(f"off_{c}") for c in columns])


def key_checks(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows, repeated keys, and null, non-finite or negative values."""
    flags = {}
    for v in values:
        flags[f"bad_{v}"] = F.col(v).isNull() | F.isnan(v) | (F.abs(F.col(v)) == float("inf"))
        flags[f"negative_{v}"] = F.col(v) < 0
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return by_key.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), *[F.sum(n).alias(n) for n in flags])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def report(checks: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row of an audit: whether all of ``checks`` (name, passed, values) hold, how many there are and fail, and the range of each value."""
    ends = [x for v in values for x in (F.min(v).alias(f"least_{v}"), F.max(v).alias(f"largest_{v}"))]
    failed = F.count_if(~F.coalesce(F.col("passed"), F.lit(False)))
    return checks.agg(F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"), F.count("*").alias("checks"), failed.alias("failed"), *ends)
