"""Geometry as column expressions: rings are arrays of structs (x, y), closed or not, in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import dealt


def _next(ring: Column) -> Column:
    """The ring moved on by one vertex."""
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def _cross(ring: Column) -> Column:
    return F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])


def signed_area(ring: Column) -> Column:
    """Shoelace formula; positive when counter-clockwise."""
    return F.aggregate(_cross(ring), F.lit(0.0), lambda s, c: s + c) / 2


def centroid(ring: Column) -> Column:
    """Struct (x, y); null for a ring without area."""
    weigh = lambda axis: F.aggregate(
        F.zip_with(ring, _next(ring), lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])), F.lit(0.0), lambda s, c: s + c
    )
    six = 6 * signed_area(ring)
    return F.struct(F.try_divide(weigh("x"), six).alias("x"), F.try_divide(weigh("y"), six).alias("y"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether an odd number of edges cross the ray to the right."""
    crosses = F.zip_with(
        ring, _next(ring),
        lambda a, b: F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])), F.lit(False)),
    )
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def points_along(edges: DataFrame, spacing: float = 15.0) -> DataFrame:
    """Equally spaced points on straight edges (edge, ax, ay, bx, by): floor(length / spacing) + 1, two at least."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = F.greatest(F.lit(2), F.floor(length / spacing).cast("int") + 1)
    rows = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("i") / (F.col("n") - 1)
    return rows.select("edge", "i", (F.col("ax") + at * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + at * (F.col("by") - F.col("ay"))).alias("y"))


def cell(value: Column, origin: float, size: float, most: int | None = None) -> Column:
    """Index of the cell of a coordinate, clipped to 0..most."""
    at = F.floor((value - origin) / size).cast("int")
    return at if most is None else F.least(F.greatest(at, F.lit(0)), F.lit(most))


def covered_cells(features: DataFrame, size: float) -> DataFrame:
    """A row for every cell of a feature's box whose centre lies in its ring."""
    low = lambda a: F.floor(F.array_min(F.transform("ring", lambda p: p[a])) / size).cast("int")
    high = lambda a: F.floor(F.array_max(F.transform("ring", lambda p: p[a])) / size).cast("int")
    boxes = features.withColumn("col", F.explode(F.sequence(low("x"), high("x")))).withColumn("row", F.explode(F.sequence(low("y"), high("y"))))
    return boxes.where(inside(F.col("ring"), (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size))


def cells_inside(features: DataFrame, size: float) -> DataFrame:
    """(row, col, h) of the cells whose centre lies in a ring; of overlapping features the last in ``feature`` order wins."""
    return covered_cells(features, size).groupBy("row", "col").agg(F.max_by("h", "feature").alias("h"))


def zonal_statistics(footprints: DataFrame, heights: DataFrame, size: float) -> DataFrame:
    """Cells, median and upper quantiles of ``heights`` (sheet, row, col, h) in each footprint; the sheet with most cells counts."""
    cells = covered_cells(footprints, size).select("feature", "row", "col")
    stats = cells.join(heights, ["row", "col"]).groupBy("feature", "sheet").agg(
        F.count("*").alias("cells"), F.percentile("h", F.lit(0.5)).alias("h_median"), F.percentile("h", F.lit(0.75)).alias("h_p75"), F.percentile("h", F.lit(0.9)).alias("h_p90")
    )
    best = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("cells"), "sheet"))
    return stats.withColumn("place", best).where("place = 1").drop("place")


def nearest_within(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """The nearest target (target, x, y) of each point within a distance, ties to the least name: equal cells and their neighbours meet."""
    near = F.sequence(F.lit(-1), F.lit(1))
    at = lambda c: F.floor(F.col(c) / metres)
    spots = targets.select("target", F.col("x").alias("tx"), F.col("y").alias("ty")).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spots = spots.withColumn("cx", at("tx") + F.col("dx")).withColumn("cy", at("ty") + F.col("dy")).drop("dx", "dy")
    rows = points.withColumn("cx", at("x")).withColumn("cy", at("y")).join(dealt(spots), ["cx", "cy"])
    far = F.round(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")), 6)
    return rows.withColumn("d", far).where(F.col("d") <= metres).groupBy("point").agg(F.min_by("target", F.struct("d", "target")).alias("target"), F.min("d").alias("d"))


def from_east_edge(df: DataFrame, x: str = "x") -> DataFrame:
    """Kilometres from the easternmost row."""
    edge = df.agg(F.max(x).alias("edge"))
    return df.crossJoin(F.broadcast(edge)).withColumn("east_km", (F.col(x) - F.col("edge")) / 1000).drop("edge")
