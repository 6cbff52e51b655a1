"""Geometry and shade queries: parts are buildings on a grid of cells, with their size as floors."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.stats import cosine_law_km
from umbra.operators import geometry as G
from umbra.operators import shade as S
from umbra.operators import spatial as P
from umbra.plans.inputs import REGISTRY, observations, read, sections, stations, view

SUNS = [("morning", 20.0, 95.0), ("noon", 70.0, 180.0), ("evening", 12.0, 285.0), ("low", 3.0, 295.0)]
_SUNS = "(VALUES ('morning', 20.0::DOUBLE, 95.0::DOUBLE), ('noon', 70.0, 180.0), ('evening', 12.0, 285.0), ('low', 3.0, 295.0)) s(sun, elevation, azimuth)"
GRID = 200


def cells(spark, d):
    key = F.col("p_partkey")
    rows = read(spark, d, "part").select(F.pmod(key * 31, F.lit(GRID)).cast("int").alias("row"), F.pmod(key * 17, F.lit(GRID)).cast("int").alias("col"), S.floors_height(F.col("p_size")).alias("h"))
    return rows.groupBy("row", "col").agg(F.max("h").alias("h"))


def suns(spark):
    return spark.createDataFrame(SUNS, "sun string, elevation double, azimuth double")


view("cells", f"SELECT (p_partkey * 31 % {GRID})::INTEGER AS row, (p_partkey * 17 % {GRID})::INTEGER AS col, max(3.0::DOUBLE * p_size + 1) AS h FROM part GROUP BY 1, 2")
view(
    "shaded",
    f"""SELECT DISTINCT sun, row, col FROM (
        SELECT sun, (row - round_even(round(n * -cos(radians(azimuth)), 9), 0))::INTEGER AS row, (col - round_even(round(n * sin(radians(azimuth)), 9), 0))::INTEGER AS col
        FROM (SELECT *, unnest(range(1, ceil(h / (tan(radians(elevation)) * 3))::BIGINT)) AS n FROM cells, {_SUNS} WHERE elevation > 5))
        WHERE row BETWEEN 0 AND {GRID - 1} AND col BETWEEN 0 AND {GRID - 1}""",
    ["cells"],
)


def shaded(spark, d):
    return S.shaded_cells(cells(spark, d), suns(spark), 3.0, GRID, GRID)


@REGISTRY.add("shd_shaded_cells", "SELECT sun, row, col FROM shaded", "shaded")
def _(spark, d):
    return shaded(spark, d)


def points(spark, d):
    """Sample points of straight edges between sections and the next station's corner of the grid."""
    rows = sections(spark, d).select(F.col("cusec").alias("edge"), (F.col("x") * 0.03).alias("ax"), (F.col("y") * 0.03).alias("ay"), (F.col("y") * 0.03).alias("bx"), (F.col("x") * 0.03).alias("by"))
    return G.points_along(rows)


view(
    "points",
    """SELECT edge, i, ax + i / (n - 1) * (bx - ax) AS x, ay + i / (n - 1) * (by_ - ay) AS y FROM (
        SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(2, floor(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) / 15)::INTEGER + 1) AS n FROM (
            SELECT cusec AS edge, x * 0.03::DOUBLE AS ax, y * 0.03::DOUBLE AS ay, y * 0.03::DOUBLE AS bx, x * 0.03::DOUBLE AS by_ FROM sections)))""",
    ["sections"],
)


@REGISTRY.add("geo_points_along", "SELECT edge, i::INTEGER AS i, x, y FROM points", "points", "x y")
def _(spark, d):
    return points(spark, d)


@REGISTRY.add(
    "shd_edge_shade",
    f"""SELECT edge, s.sun, avg(CASE WHEN elevation <= 5 THEN 1.0 WHEN h.sun IS NOT NULL THEN 1.0 ELSE 0.0 END) AS frac
        FROM (SELECT edge, least(greatest(floor(round(y, 6) / 3), 0), {GRID - 1})::INTEGER AS row, least(greatest(floor(round(x, 6) / 3), 0), {GRID - 1})::INTEGER AS col FROM points) p CROSS JOIN {_SUNS}
        LEFT JOIN shaded h ON h.sun = s.sun AND h.row = p.row AND h.col = p.col GROUP BY ALL""",
    "points shaded",
    "frac",
)
def _(spark, d):
    at = points(spark, d).select("edge", G.cell(F.round("y", 6), 0.0, 3.0, GRID - 1).alias("row"), G.cell(F.round("x", 6), 0.0, 3.0, GRID - 1).alias("col"))
    return S.edge_shade(at, shaded(spark, d), suns(spark))


def buildings(spark, d):
    key = F.col("p_partkey")
    return read(spark, d, "part").select(
        key.alias("feature"), F.col("p_size").alias("floors"), F.pmod(key, F.lit(9)).alias("cells"), F.when(F.pmod(key, F.lit(11)) > 0, 2.5 * F.col("p_size") + F.pmod(key, F.lit(7))).alias("h_p75"),
        F.concat(F.col("p_size").cast("string"), F.lit(",5 m")).alias("noted"),
    )


view(
    "buildings",
    """SELECT p_partkey AS feature, p_size AS floors, p_partkey % 9 AS cells, CASE WHEN p_partkey % 11 > 0 THEN 2.5::DOUBLE * p_size + p_partkey % 7 END AS h_p75, p_size || ',5 m' AS noted,
       CASE WHEN p_size > 0 AND p_size <= 2 THEN '1-2' WHEN p_size > 2 AND p_size <= 5 THEN '3-5' WHEN p_size > 5 AND p_size <= 9 THEN '6-9' WHEN p_size > 9 THEN '10+' END AS band FROM part""",
)


@REGISTRY.add(
    "shd_final_height",
    """WITH b AS (SELECT band, median((h_p75 - 1) / floors) AS per_floor FROM buildings WHERE cells >= 4 AND h_p75 IS NOT NULL AND floors > 0 GROUP BY band)
    SELECT feature, CASE WHEN cells >= 4 AND h_p75 IS NOT NULL THEN h_p75 ELSE floors * coalesce(per_floor, 3.0) + 1 END AS height, CASE WHEN cells >= 4 AND h_p75 IS NOT NULL THEN 'measured' ELSE 'modelled' END AS origin
    FROM buildings LEFT JOIN b USING (band)""",
    "buildings",
    "height",
)
def _(spark, d):
    return S.final_height(buildings(spark, d)).select("feature", "height", "origin")


@REGISTRY.add(
    "shd_agreement",
    """WITH x AS (SELECT band, replace(regexp_extract(replace(noted, ',', '.'), '-?\\d+\\.?\\d*'), ',', '.')::DOUBLE AS a, floors::DOUBLE AS b FROM buildings)
    SELECT band, count(*) AS n, avg(a - b) AS bias, avg(abs(a - b)) AS mae, sqrt(avg(power(a - b, 2))) AS rmse, 100 * count_if(a = b) / count(*) AS equal_pct, 100 * count_if(abs(a - b) <= 1) / count(*) AS near_pct,
           covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS r FROM x GROUP BY band""",
    "buildings",
    "bias mae rmse equal_pct near_pct r",
)
def _(spark, d):
    rows = buildings(spark, d).select(S.band(F.col("floors")).alias("band"), S.number_in(F.col("noted")).alias("a"), F.col("floors").cast("double").alias("b"))
    return S.agreement(rows, "a", "b", ["band"])


@REGISTRY.add(
    "geo_nearest_within",
    """SELECT cusec AS point, station AS target, d FROM (SELECT cusec, station, round(sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)), 6) AS d FROM sections c, stations s)
       WHERE d <= 1500 QUALIFY row_number() OVER (PARTITION BY cusec ORDER BY d, station) = 1""",
    "sections stations",
    "d",
)
def _(spark, d):
    at = sections(spark, d).select(F.col("cusec").alias("point"), "x", "y")
    return P.nearest_in_turn(at, stations(spark, d).select(F.col("station").alias("target"), "x", "y"), [250.0, 1500.0]).drop("radius")


def rings(spark, d):
    """A pentagon around every section."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return sections(spark, d).select("cusec", F.array(corner(0, 0), corner(40, 0), corner(60, 30), corner(20, 50), corner(-10, 30)).alias("ring"))


@REGISTRY.add("geo_area_centroid", "SELECT cusec, 2350.0::DOUBLE AS area, x + 323000.0::DOUBLE / 14100 AS cx, y + 316000.0::DOUBLE / 14100 AS cy FROM sections", "sections", "area cx cy")
def _(spark, d):
    rows = rings(spark, d).withColumn("c", G.centroid(F.col("ring")))
    return rows.select("cusec", G.signed_area(F.col("ring")).alias("area"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@REGISTRY.add("geo_from_east_edge", "SELECT cusec, (x - (SELECT max(x) FROM sections)) / 1000 AS east_km FROM sections", "sections", "east_km")
def _(spark, d):
    return G.from_east_edge(sections(spark, d)).select("cusec", "east_km")


# suns, exposure and zones

PLACE = (39.47, -0.38)
TRANSMITTANCE = [0.0, 0.2, 0.4]


@REGISTRY.add(
    "shd_sun_positions",
    """WITH a AS (SELECT DISTINCT dayofyear(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour FROM obs), g AS (SELECT *, 2 * pi() * (day - 1) / 365 AS g FROM a),
    e AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec,
        radians(((hour + 0.5) * 60 + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4 * -0.38::DOUBLE) / 4 - 180) AS angle, radians(39.47::DOUBLE) AS lat FROM g)
    SELECT day, hour, degrees(asin(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(angle))) AS elevation,
        (degrees(atan2(-sin(angle) * cos(dec), cos(lat) * sin(dec) - sin(lat) * cos(dec) * cos(angle))) + 360) % 360 AS azimuth FROM e""",
    "obs",
    "elevation azimuth",
)
def _(spark, d):
    when = observations(spark, d).select(F.dayofyear("ts").alias("day"), F.hour("ts").alias("hour")).distinct()
    elevation, azimuth = S.sun_position(*PLACE, F.col("day"), F.col("hour") + 0.5)
    return when.select("day", "hour", elevation.alias("elevation"), azimuth.alias("azimuth"))


_EDGE = f"""SELECT edge, s.sun, avg(CASE WHEN elevation <= 5 OR h.sun IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS frac
    FROM (SELECT edge, least(greatest(floor(round(y, 6) / 3), 0), {GRID - 1})::INTEGER AS row, least(greatest(floor(round(x, 6) / 3), 0), {GRID - 1})::INTEGER AS col FROM points) p CROSS JOIN {_SUNS}
    LEFT JOIN shaded h ON h.sun = s.sun AND h.row = p.row AND h.col = p.col GROUP BY ALL"""


def edge_fractions(spark, d):
    at = points(spark, d).select("edge", G.cell(F.round("y", 6), 0.0, 3.0, GRID - 1).alias("row"), G.cell(F.round("x", 6), 0.0, 3.0, GRID - 1).alias("col"))
    return S.edge_shade(at, shaded(spark, d), suns(spark))


def edge_lengths(spark, d):
    return sections(spark, d).select(F.col("cusec").alias("edge"), (F.abs(F.col("x") - F.col("y")) + 1).alias("length"))


@REGISTRY.add(
    "shd_network_shade", f"SELECT sun, sum(frac * length) / sum(length) AS shade FROM ({_EDGE}) JOIN (SELECT cusec AS edge, abs(x - y) + 1 AS length FROM sections) USING (edge) GROUP BY sun", "points shaded", "shade"
)
def _(spark, d):
    return S.network_shade(edge_fractions(spark, d), edge_lengths(spark, d))


def canopy(spark, d):
    key = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select(F.pmod(key * 31, F.lit(GRID)).cast("int").alias("row"), F.pmod(key * 13, F.lit(GRID)).cast("int").alias("col"), (F.pmod(key, F.lit(9)) + 4.0).alias("h"))
    return rows.groupBy("row", "col").agg(F.max("h").alias("h"))


view("canopy", f"SELECT (s_suppkey * 31 % {GRID})::INTEGER AS row, (s_suppkey * 13 % {GRID})::INTEGER AS col, max(s_suppkey % 9 + 4.0::DOUBLE) AS h FROM supplier GROUP BY 1, 2")


@REGISTRY.add("shd_obstructions", "SELECT row, col, coalesce(greatest(b.h, c.h), b.h, c.h) AS h, coalesce(b.h, 0) <= 0 AS only_canopy FROM cells b FULL JOIN canopy c USING (row, col)", "cells canopy", "h")
def _(spark, d):
    return S.obstructions(cells(spark, d), canopy(spark, d))


@REGISTRY.add(
    "shd_exposure",
    """SELECT tau, l_returnflag AS kind, sum(l_quantity * (greatest(0, least(1, 1 - (l_discount + l_tax) * 5)) + tau * greatest(0, least(1, (l_discount + l_tax) * 5 - l_discount * 5)))) AS sun
       FROM lineitem, (VALUES (0.0::DOUBLE), (0.2), (0.4)) t(tau) GROUP BY ALL""",
    doubles="tau sun",
)
def _(spark, d):
    taus = spark.createDataFrame([(t,) for t in TRANSMITTANCE], "tau double")
    rows = read(spark, d, "lineitem").crossJoin(F.broadcast(taus))
    sun = S.exposure(F.col("l_quantity"), F.col("l_discount") * 5, (F.col("l_discount") + F.col("l_tax")) * 5, F.col("tau"))
    return rows.groupBy("tau", F.col("l_returnflag").alias("kind")).agg(F.sum(sun).alias("sun"))


ZONE = 20.0
view(
    "ring_cells",
    """SELECT cusec, pop, row, col FROM (SELECT cusec, pop, x, y, row, unnest(range(floor((x - 10) / 20)::BIGINT, floor((x + 60) / 20)::BIGINT + 1)) AS col FROM (
        SELECT cusec, pop, x, y, unnest(range(floor(y / 20)::BIGINT, floor((y + 50) / 20)::BIGINT + 1)) AS row FROM sections))
       WHERE (SELECT count(*) FROM (VALUES (0, 0, 40, 0), (40, 0, 60, 30), (60, 30, 20, 50), (20, 50, -10, 30), (-10, 30, 0, 0)) e(ax, ay, bx, by_)
              WHERE (y + ay > (row + 0.5) * 20) <> (y + by_ > (row + 0.5) * 20) AND (col + 0.5) * 20 < x + ax + ((row + 0.5) * 20 - y - ay) * (bx - ax) / nullif(by_ - ay, 0)::DOUBLE) % 2 = 1""",
    ["sections"],
)


def zones(spark, d):
    return rings(spark, d).join(sections(spark, d).select("cusec", "pop"), "cusec").select(F.col("cusec").alias("feature"), "ring", F.col("pop").alias("h"))


@REGISTRY.add("geo_cells_inside", "SELECT row::INTEGER AS row, col::INTEGER AS col, arg_max(pop, cusec) AS h FROM ring_cells GROUP BY ALL", "ring_cells", "h")
def _(spark, d):
    return G.cells_inside(zones(spark, d), ZONE)


@REGISTRY.add(
    "geo_zonal_statistics",
    """WITH h AS (SELECT sheet, row, col, (row * 7 + col * 13 + sheet * 5) % 50 + 1.0::DOUBLE AS h FROM (SELECT DISTINCT row, col FROM ring_cells), (VALUES (1), (2)) s(sheet) WHERE (row + col) % (sheet + 1) = 0),
    s AS (SELECT cusec AS feature, sheet, count(*) AS cells, quantile_cont(h, 0.5) AS h_median, quantile_cont(h, 0.75) AS h_p75, quantile_cont(h, 0.9) AS h_p90 FROM ring_cells JOIN h USING (row, col) GROUP BY ALL)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY feature ORDER BY cells DESC, sheet) = 1""",
    "ring_cells",
    "h_median h_p75 h_p90",
)
def _(spark, d):
    rows = zones(spark, d)
    sheets = spark.createDataFrame([(1,), (2,)], "sheet int")
    at = G.covered_cells(rows, ZONE).select("row", "col").distinct().crossJoin(F.broadcast(sheets)).where("(row + col) % (sheet + 1) = 0")
    heights = at.withColumn("h", F.expr("(row * 7 + col * 13 + sheet * 5) % 50 + 1.0D"))
    return G.zonal_statistics(rows, heights, ZONE)


@REGISTRY.add(
    "geo_radius",
    """SELECT cusec, km FROM (SELECT cusec, 6371.0 * acos(least(1.0, sin(radians(39 + y / 111000)) * sin(radians(39.1::DOUBLE)) + cos(radians(39 + y / 111000)) * cos(radians(39.1::DOUBLE)) * cos(radians(0.1::DOUBLE - x / 85000)))) AS km FROM sections) WHERE km <= 8""",
    "sections",
    "km",
)
def _(spark, d):
    far = cosine_law_km(39 + F.col("y") / 111000, F.col("x") / 85000, F.lit(39.1), F.lit(0.1))
    return sections(spark, d).select("cusec", far.alias("km")).where("km <= 8")
