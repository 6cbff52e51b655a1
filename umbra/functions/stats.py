"""Statistics with the conventions of this library: null for missing, average ranks, linear quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(x: Column | str, q: float | Sequence[float]) -> Column:
    """Exact quantile with linear interpolation."""
    at = F.array(*map(F.lit, q)) if isinstance(q, (list, tuple)) else F.lit(q)
    return F.percentile(x, at)


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def sorted_quantile(values: Column, q: float) -> Column:
    """The same of a sorted array without nulls; null if it is empty."""
    at = F.lit(float(q)) * (F.size(values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(low == high, F.get(values, low)).otherwise((high - at) * F.get(values, low) + (at - low) * F.get(values, high))


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of an error when there is nothing to divide by."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def share(condition: Column) -> Column:
    """Mean of a condition; null counts as false but counts."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def average_rank(value: Column | str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank from 1 within ``by``; equal values share the mean of their ranks."""
    value = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(*by).orderBy(value.desc() if descending else value.asc())
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(a: str, b: str) -> Column:
    """Correlation; null for a constant side."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), name: str = "rho") -> DataFrame:
    """Pearson of average ranks of the rows with both values, within ``by``; null for a constant side."""
    there = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = there.withColumn("_ra", average_rank(a, by)).withColumn("_rb", average_rank(b, by))
    return ranked.groupBy(*by).agg(pearson("_ra", "_rb").alias(name), F.count("*").alias("n"))


def circular_mean(degrees: Column) -> Column:
    """Mean direction in [0, 360) of angles in degrees."""
    angle = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))), F.lit(360.0))


def sector(degrees: Column) -> Column:
    """Four sectors, right-closed: (0, 90] NE, (90, 180] SE, (180, 270] SW, (270, 360] NW; exactly 0 has none."""
    return (
        F.when((degrees > 0) & (degrees <= 90), "NE").when((degrees > 90) & (degrees <= 180), "SE")
        .when((degrees > 180) & (degrees <= 270), "SW").when((degrees > 270) & (degrees <= 360), "NW")
    )


def normal_cdf(z: Column) -> Column:
    """Rational approximation of the normal distribution (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def jaccard(a: Column, b: Column) -> Column:
    """Of two membership flags over the rows of a group."""
    return ratio(F.count_if(a & b), F.count_if(a | b))


def total_variation(df: DataFrame, p: str, q: str, by: Sequence[str] = (), name: str = "tv") -> DataFrame:
    """Half the sum of absolute differences of two shares per row."""
    return df.groupBy(*by).agg((F.sum(F.abs(F.col(p) - F.col(q))) / 2).alias(name))


def top_k(score: Column, key: str, k: Column, by: Sequence[str]) -> Column:
    """Flag of the k best by score, ties to the smaller key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), F.col(key).asc()))
    return place <= k


def quota(n: Column, fraction: float | Column) -> Column:
    """Slots for a fraction of n, rounded down, one at least."""
    return F.greatest(F.floor(n * fraction), F.lit(1)).cast("int")


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(F.radians(lon_b - lon_a) / 2), 2
    )
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def cosine_law_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Spherical law of cosines, clamped."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    inner = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon_b - lon_a))
    return 6371.0 * F.acos(F.least(F.lit(1.0), inner))
