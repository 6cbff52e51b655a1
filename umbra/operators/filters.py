"""Filters on names, columns, boxes and rings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of primary care in both languages (fixed values, matched without regard to case).
PRIMARY_CARE = "centre de salut|centro de salud|consultori|consultorio|centre sanitari|ambulatori"


def scope(area: Column, km: Column, prefix: str, near: float = 12.0) -> Column:
    """municipal by the prefix of the area's code, else metropolitan within ``near`` kilometres, else periurban."""
    return F.when(area.startswith(prefix), "municipal").when(km < near, "metropolitan").otherwise("periurban")


def named(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose name matches somewhere, whatever the case; a missing name is empty."""
    return df.where(F.coalesce(F.col(column), F.lit("")).rlike(f"(?i){pattern}"))


def renamed_by(df: DataFrame, pattern: str, to: str, required: bool = True) -> DataFrame:
    """The first column whose name matches becomes ``to``; without one the first column does if it is required, else there is a null one."""
    found = next((c for c in df.columns if re.search(pattern, c, re.I)), df.columns[0] if required else None)
    return df.withColumn(to, F.lit(None).cast("string")) if found is None else df.withColumnRenamed(found, to)


def usable_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Rows with a ring of three different corners at least, none of them without a coordinate."""
    corners = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return df.where((F.size(F.array_distinct(corners)) > 2) & (F.size(corners) == F.size(ring)))


def boxed(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds x0, y0, x1, y1: the box of the ring."""
    end = lambda f, axis: f(F.transform(ring, lambda p: p[axis]))
    return df.withColumns({"x0": end(F.array_min, "x"), "y0": end(F.array_min, "y"), "x1": end(F.array_max, "x"), "y1": end(F.array_max, "y")})


def meeting_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose box (x0, y0, x1, y1) meets the given one; plain comparisons, which reach a file's statistics when the box is stored."""
    return df.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
