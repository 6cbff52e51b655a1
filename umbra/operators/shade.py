"""Building heights and the cells they shade.

Cells are (row, col, h) with h > 0 only; row grows to the south. Every obstructing cell throws its shadow step
by step away from the sun, so the work grows with the shaded cells and not with the raster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.stats import median, pearson, ratio


def floors_height(floors: Column, per_floor: float = 3.0) -> Column:
    return per_floor * floors + 1.0


def number_in(text: Column) -> Column:
    """The first number of a free text, a comma read as a point."""
    return F.regexp_extract(F.regexp_replace(text, ",", "."), r"-?\d+\.?\d*", 0).try_cast("double")


def band(floors: Column) -> Column:
    """Right-closed bands of floors; 0 or less has none."""
    return F.when((floors > 0) & (floors <= 2), "1-2").when((floors > 2) & (floors <= 5), "3-5").when((floors > 5) & (floors <= 9), "6-9").when(floors > 9, "10+")


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias, errors and shares of equal and near values of a against b."""
    off = F.col(a) - F.col(b)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"),
        (100 * ratio(F.count_if(off == 0), F.count("*"))).alias("equal_pct"), (100 * ratio(F.count_if(F.abs(off) <= 1), F.count("*"))).alias("near_pct"), pearson(a, b).alias("r"),
    )


def final_height(buildings: DataFrame, least_cells: int = 4, default: float = 3.0) -> DataFrame:
    """The measured upper quartile where it rests on enough cells, else floors times the band's median metres per floor; with its origin."""
    rows = buildings.withColumn("band", band(F.col("floors")))
    measured = F.coalesce(F.col("cells") >= least_cells, F.lit(False)) & F.col("h_p75").isNotNull()
    per_floor = rows.where(measured).where("floors > 0").groupBy("band").agg(median((F.col("h_p75") - 1) / F.col("floors")).alias("per_floor"))
    rows = rows.join(F.broadcast(per_floor), "band", "left")  # a row per band
    modelled = F.col("floors") * F.coalesce("per_floor", F.lit(default)) + 1
    return rows.withColumn("height", F.when(measured, F.col("h_p75")).otherwise(modelled)).withColumn("origin", F.when(measured, "measured").otherwise("modelled"))


def sun_position(latitude: float, longitude: float, day: Column, utc_hour: Column) -> tuple[Column, Column]:
    """(elevation, azimuth) in degrees from declination and hour angle (Spencer's series), azimuth from north over east."""
    g = 2 * 3.141592653589793 * (day - 1) / 365
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    angle = F.radians((utc_hour * 60 + equation + 4 * longitude) / 4 - 180)
    lat = F.radians(F.lit(latitude))
    sine = F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(angle)
    azimuth = F.atan2(-F.sin(angle) * F.cos(declination), F.cos(lat) * F.sin(declination) - F.sin(lat) * F.cos(declination) * F.cos(angle))
    return F.degrees(F.asin(sine)), F.pmod(F.degrees(azimuth), F.lit(360.0))


def shaded_cells(cells: DataFrame, suns: DataFrame, size: float, rows: int, cols: int) -> DataFrame:
    """(sun, row, col) of the cells in shadow within the grid; ``suns`` (sun, elevation, azimuth) is a small table.

    A cell is shaded if some step n towards the sun meets a height over n * size * tan(elevation), strictly. Seen
    from the obstruction: it shades the cells at steps 1 to ceil(h / (size * tan)) - 1 away from the sun, offsets rounded
    half to even.
    """
    tangent = F.tan(F.radians("elevation")) * size
    reach = (F.ceil(F.col("h") / tangent) - 1).cast("int")
    thrown = cells.where("h > 0").crossJoin(F.broadcast(suns.where("elevation > 5"))).withColumn("reach", reach).where("reach >= 1")
    steps = thrown.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("reach"))))
    down, right = -F.cos(F.radians("azimuth")), F.sin(F.radians("azimuth"))
    moved = lambda at, unit: (F.col(at) - F.bround(F.round(F.col("n") * unit, 9))).cast("int")
    out = steps.select("sun", moved("row", down).alias("row"), moved("col", right).alias("col"))
    return out.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).distinct()


def edge_shade(points: DataFrame, shaded: DataFrame, suns: DataFrame) -> DataFrame:
    """(edge, sun, frac): share of an edge's sample points (edge, row, col) in shadow; all of them under a low sun."""
    each = points.crossJoin(F.broadcast(suns.select("sun", "elevation")))
    dark = shaded.withColumn("dark", F.lit(1.0))
    rows = each.join(dark, ["sun", "row", "col"], "left")
    value = F.when(F.col("elevation") <= 5, 1.0).otherwise(F.coalesce("dark", F.lit(0.0)))
    return rows.groupBy("edge", "sun").agg(F.avg(value).alias("frac"))


def network_shade(shade: DataFrame, lengths: DataFrame) -> DataFrame:
    """Length-weighted shaded share of the network under each sun."""
    return shade.join(lengths, "edge").groupBy("sun").agg(ratio(F.sum(F.col("frac") * F.col("length")), F.sum("length")).alias("shade"))


def obstructions(buildings: DataFrame, canopy: DataFrame) -> DataFrame:
    """The higher of both at each cell, and whether only the canopy stands there."""
    rows = buildings.withColumnRenamed("h", "hb").join(canopy.withColumnRenamed("h", "hc"), ["row", "col"], "full_outer")
    return rows.select("row", "col", F.greatest("hb", "hc").alias("h"), (F.coalesce("hb", F.lit(0.0)) <= 0).alias("only_canopy"))


def exposure(minutes: Column, by_building: Column, by_all: Column, transmittance: Column) -> Column:
    """Sun minutes when the canopy's share of the shade lets some light through."""
    open_ = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - by_all))
    canopy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), by_all - by_building))
    return minutes * (open_ + transmittance * canopy)


def least_factors(cells: DataFrame, suns: DataFrame, size: float, rows: int, cols: int, most: float) -> DataFrame:
    """(sun, row, col, least): cells that lie in shadow when all heights are times a factor above ``least``, for factors up to ``most``.

    One cast answers for all factors: step n from an obstruction is dark when h * factor > n * size * tan(elevation), so each cell
    keeps the least n * size * tan(elevation) / h that meets it.
    """
    tangent = F.tan(F.radians("elevation")) * size
    thrown = cells.where("h > 0").crossJoin(F.broadcast(suns.where("elevation > 5"))).withColumn("tangent", tangent)
    thrown = thrown.withColumn("reach", (F.ceil(F.col("h") * most / F.col("tangent")) - 1).cast("int")).where("reach >= 1")
    steps = thrown.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("reach"))))
    down, right = -F.cos(F.radians("azimuth")), F.sin(F.radians("azimuth"))
    moved = lambda at, unit: (F.col(at) - F.bround(F.round(F.col("n") * unit, 9))).cast("int")
    out = steps.select("sun", moved("row", down).alias("row"), moved("col", right).alias("col"), (F.col("n") * F.col("tangent") / F.col("h")).alias("least"))
    return out.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("sun", "row", "col").agg(F.min("least").alias("least"))


def factor_shade(points: DataFrame, least: DataFrame, suns: DataFrame, factors: Sequence[float]) -> DataFrame:
    """(edge, sun, factor, frac): ``edge_shade`` for every factor of the heights, from one pass over the sample points."""
    rows = points.crossJoin(F.broadcast(suns.select("sun", "elevation"))).join(least, ["sun", "row", "col"], "left")
    dark = lambda f: F.when((F.col("elevation") <= 5) | F.coalesce(F.col("least") < f, F.lit(False)), 1.0).otherwise(0.0)
    wide = rows.groupBy("edge", "sun").agg(*[F.avg(dark(f)).alias(f"f{i}") for i, f in enumerate(factors)])
    each = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("factor"), F.col(f"f{i}").alias("frac")) for i, f in enumerate(factors)]))
    return wide.select("edge", "sun", each.alias("x")).select("edge", "sun", "x.*")


def factor_changes(shade: DataFrame, lengths: DataFrame) -> DataFrame:
    """Length-weighted shade of the network under each sun and factor, and its change against heights as they are."""
    rows = shade.join(lengths, "edge").groupBy("sun", "factor").agg(ratio(F.sum(F.col("frac") * F.col("length")), F.sum("length")).alias("shade"))
    central = rows.where("factor = 1").select("sun", F.col("shade").alias("central"))
    return rows.join(F.broadcast(central), "sun").select("sun", "factor", "shade", (F.col("shade") - F.col("central")).alias("change"))  # a row for each sun


def floor_metres(buildings: DataFrame, height: str, ground: float = 1.0, per_floor: float = 3.0) -> DataFrame:
    """Measured metres per floor (quartiles) and the error of modelled heights, in each band of floors and overall (band all)."""
    rows = buildings.where((F.col("floors") > 0) & F.col(height).isNotNull()).withColumn("band", F.explode(F.array_compact(F.array(F.lit("all"), band(F.col("floors"))))))
    off = floors_height(F.col("floors"), per_floor) - F.col(height)
    q = F.percentile((F.col(height) - ground) / F.col("floors"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy("band").agg(F.count("*").alias("n"), q.alias("q"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))
    return out.select("band", "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q2"), F.get("q", F.lit(2)).alias("q3"), "bias", "mae", "rmse")
