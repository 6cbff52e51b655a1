"""Day and block bootstraps from partial sums: no row is ever repeated.

Replicates say how often a day is drawn. Draws come from a linear congruence, so they are the same on every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.stats import median, ratio, sorted_quantile


def draw(b: Column, i: Column, n: Column) -> Column:
    """A place in 0..n-1 for draw ``i`` of replicate ``b``."""
    return F.pmod(F.pmod(b * 7919 + i * 104729 + 17, F.lit(1_000_003)) * 48271 + b * i, n)


def numbered_days(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct days with their place from 0 and their number within ``by``."""
    distinct = days.select(*by, "date").distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def day_replicates(days: DataFrame, reps: int) -> DataFrame:
    """(b, date, times): whole days drawn with replacement, as many as there are."""
    places = numbered_days(days)
    drawn = places.select("n", F.col("place").cast("long").alias("i")).crossJoin(F.broadcast(days.sparkSession.range(reps).withColumnRenamed("id", "b")))
    counts = drawn.groupBy("b", draw(F.col("b"), F.col("i"), F.col("n")).alias("place")).agg(F.count("*").alias("times"))
    return counts.join(places.select("place", "date"), "place").select("b", "date", "times")


def block_replicates(days: DataFrame, reps: int, length: int, by: str) -> DataFrame:
    """(b, by, date, times): moving blocks of ``length`` days within each group, cut to its number of days; short groups are taken whole."""
    places = numbered_days(days, [by])
    sizes = places.groupBy(by).agg(F.max("n").alias("n"))
    blocks = F.ceil(F.col("n") / length)
    starts = sizes.crossJoin(F.broadcast(days.sparkSession.range(reps).withColumnRenamed("id", "b"))).select(
        by, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i")
    )
    start = F.when(F.col("n") <= length, F.lit(0).cast("long")).otherwise(draw(F.col("b"), F.col("i"), F.col("n") - length + 1))
    rows = starts.withColumn("start", start).select(by, "n", "b", "i", "start", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o"))
    cut = rows.where((F.col("i") * length + F.col("o") < F.col("n")) & (F.col("start") + F.col("o") < F.col("n")))
    counts = cut.groupBy(by, "b", (F.col("start") + F.col("o")).alias("place")).agg(F.count("*").alias("times"))
    return counts.join(places, [by, "place"]).select("b", by, "date", "times")


def circular_replicates(days: DataFrame, reps: int, length: int = 7, year: int = 92) -> DataFrame:
    """(b, place, times): blocks around a circle of ``year`` days, shared by all sites, the first ``year`` of them."""
    spark = days.sparkSession
    blocks = -(-year // length)
    rows = spark.range(reps).withColumnRenamed("id", "b").crossJoin(F.broadcast(spark.range(blocks).withColumnRenamed("id", "i")))
    start = draw(F.col("b"), F.col("i"), F.lit(year))
    each = rows.select("b", "i", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o"))
    cut = each.where(F.col("i") * length + F.col("o") < year)
    return cut.groupBy("b", F.pmod(F.col("start") + F.col("o"), F.lit(year)).alias("place")).agg(F.count("*").alias("times"))


def day_sums(rows: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """(unit, date, total, n): what every statistic of means needs of a day."""
    return rows.where(F.col(value).isNotNull()).groupBy(*unit, "date").agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def _packed(sums: DataFrame, replicates: DataFrame, unit: Sequence[str], on: Sequence[str], width: int) -> DataFrame:
    """(unit, pack, values): the means of each unit in ``width`` replicates, null in those without its days.

    A row of a day meets ``width`` replicates at once, as columns, so there are that many fewer rows to group. Sums are shuffled once, by unit, before
    they meet the replicates of their days, of which there are few; so no replicate is shuffled.
    """
    places = range(width)
    times = [F.sum(F.when(F.col("b") % width == i, F.col("times"))).alias(f"t{i}") for i in places]
    packed = small(replicates.groupBy(*on, F.floor(F.col("b") / width).alias("pack")).agg(*times))
    both = [F.sum(F.col(x) * F.col(f"t{i}")).alias(f"{x}{i}") for i in places for x in ("total", "n")]
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not by the bytes of the sums, as their replicates are many times larger
    rows = sums.repartition(parts, *unit).join(packed, list(on)).groupBy(*unit, "pack").agg(*both)
    return rows.select(*unit, "pack", F.array(*[ratio(F.col(f"total{i}"), F.col(f"n{i}")) for i in places]).alias("values"))


def replicated_means(sums: DataFrame, replicates: DataFrame, unit: Sequence[str], on: Sequence[str] = ("date",), width: int = 25) -> DataFrame:
    """(unit, b, value): the mean of each unit in each replicate; replicates without its days are missing."""
    rows = _packed(sums, replicates, unit, on, width).select(*unit, "pack", F.posexplode("values").alias("i", "value"))
    return rows.select(*unit, (F.col("pack") * width + F.col("i")).alias("b"), "value").where("value is not null")


def replicated_intervals(sums: DataFrame, replicates: DataFrame, unit: Sequence[str], on: Sequence[str] = ("date",), width: int = 25) -> DataFrame:
    """``intervals`` of the replicated means. A unit's means are sorted in an array of its own, so no rows of replicates are made, sorted or spilled."""
    rows = _packed(sums, replicates, unit, on, width).groupBy(*unit).agg(F.flatten(F.collect_list("values")).alias("values"))
    rows = rows.withColumn("values", F.sort_array(F.array_compact("values"))).where(F.size("values") > 0)
    rows = rows.select(*unit, *[sorted_quantile(F.col("values"), q).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))], F.size("values").cast("long").alias("reps"))
    return rows.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def intervals(means: DataFrame, unit: Sequence[str]) -> DataFrame:
    """95 % percentile interval and median over replicates, and whether zero is outside."""
    q = means.groupBy(*unit).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("value").alias("reps"))
    at = lambda i: F.get("q", F.lit(i))
    return q.select(*unit, at(0).alias("low"), at(1).alias("middle"), at(2).alias("high"), "reps", ((at(0) > 0) | (at(2) < 0)).alias("significant"))


def width_ratio(by_block: DataFrame, unit: Sequence[str], long: int, short: int) -> DataFrame:
    """How much wider the interval of long blocks is than that of short ones, and how far the median moves."""
    pick = lambda length, column: F.max(F.when(F.col("length") == length, F.col(column)))
    width = F.col("high") - F.col("low")
    rows = by_block.withColumn("width", width)
    return rows.groupBy(*unit).agg(
        ratio(pick(long, "width"), pick(short, "width")).alias("width_ratio"), F.abs(pick(long, "middle") - pick(short, "middle")).alias("shift")
    )


def median_width_ratio(ratios: DataFrame) -> DataFrame:
    return ratios.agg(median("width_ratio").alias("median_ratio"), F.max("width_ratio").alias("largest_ratio"), F.max("shift").alias("largest_shift"))
