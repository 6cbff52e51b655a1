"""Spatial queries: customers own concave lots, orders are points, line items are height cells of overlapping sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import spatial as P
from umbra.plans.inputs import REGISTRY, read, sections, stations, view

SIZE = 250.0
CORNERS = [(0, 0), (4, 0), (4, 2), (2, 1), (0, 4)]
_SIDES = "(VALUES " + ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)) + ") e(ax, ay, bx, by_)"


def lots(spark, d):
    """A concave lot at every section, and in every ninth a hole."""
    s = F.pmod(F.col("c_custkey"), F.lit(7)) * 25.0 + 50
    rows = sections(spark, d).join(read(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("cusec"), s.alias("s"), "c_custkey"), "cusec")
    ring = lambda dx, k: F.array(*[F.struct((F.col("x") + F.col("s") * (dx + k * a)).alias("x"), (F.col("y") + F.col("s") * (dx + k * b)).alias("y")) for a, b in CORNERS])
    outer = rows.select(F.col("cusec").alias("polygon"), ring(0.0, 1.0).alias("ring"))
    return outer.unionByName(rows.where(F.pmod("c_custkey", F.lit(9)) == 0).select(F.col("cusec").alias("polygon"), ring(0.25, 0.125).alias("ring")))


def places(spark, d):
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        key.alias("point"), (F.pmod(key * 7919, F.lit(20600)) - 149.5).alias("x"), (F.pmod(key * 104729, F.lit(20600)) - 149.75).alias("y"), F.col("o_totalprice").alias("price")
    )


view("lots", "SELECT lpad(c_custkey::VARCHAR, 7, '0') AS polygon, ((c_custkey * 7919) % 20000)::DOUBLE AS x, ((c_custkey * 104729) % 20000)::DOUBLE AS y, c_custkey % 7 * 25.0::DOUBLE + 50 AS s, c_custkey % 9 = 0 AS hole FROM customer")
view("places", "SELECT o_orderkey AS point, (o_orderkey * 7919) % 20600 - 149.5::DOUBLE AS x, (o_orderkey * 104729) % 20600 - 149.75::DOUBLE AS y, o_totalprice AS price FROM orders")
view(
    "lot_sides",
    f"""SELECT polygon, x + s * ax AS ax, y + s * ay AS ay, x + s * bx AS bx, y + s * by_ AS by_ FROM lots, {_SIDES} UNION ALL
        SELECT polygon, x + s * (0.25 + 0.125 * ax), y + s * (0.25 + 0.125 * ay), x + s * (0.25 + 0.125 * bx), y + s * (0.25 + 0.125 * by_) FROM lots, {_SIDES} WHERE hole""",
    ["lots"],
)
view("lot_boxes", "SELECT polygon, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM lot_sides GROUP BY polygon", ["lot_sides"])
view(
    "lot_points",
    """SELECT point, polygon FROM (SELECT point, p.x, p.y, polygon FROM places p JOIN lot_boxes ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1) JOIN lot_sides USING (polygon)
       GROUP BY point, polygon HAVING count_if((ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / nullif(by_ - ay, 0)) % 2 = 1""",
    ["places", "lot_boxes", "lot_sides"],
)
view(
    "lot_near",
    """SELECT point, polygon, min(d) AS d FROM (SELECT point, polygon, round(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (by_ - ay), 2)), 6) AS d FROM (
        SELECT point, p.x, p.y, e.*, least(greatest(((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)), 0), 1) AS t
        FROM places p JOIN lot_sides e ON p.x BETWEEN least(ax, bx) - 150 AND greatest(ax, bx) + 150 AND p.y BETWEEN least(ay, by_) - 150 AND greatest(ay, by_) + 150)) WHERE d <= 150 GROUP BY ALL""",
    ["places", "lot_sides"],
)


@REGISTRY.add("geo_first_containing", "SELECT point, price, first_lot AS polygon FROM places LEFT JOIN (SELECT point, min(polygon) AS first_lot FROM lot_points GROUP BY point) USING (point)", "lot_points", "price")
def _(spark, d):
    return P.first_containing(places(spark, d), lots(spark, d), SIZE).select("point", "price", "polygon")


@REGISTRY.add("geo_containing", "SELECT point, polygon FROM lot_points", "lot_points")
def _(spark, d):
    return P.containing(places(spark, d), lots(spark, d), SIZE)


@REGISTRY.add("geo_within_margin", "SELECT point, min(d) AS d FROM (SELECT point, 0.0::DOUBLE AS d FROM lot_points UNION ALL SELECT point, d FROM lot_near) GROUP BY point", "lot_points lot_near", "d")
def _(spark, d):
    return P.within_margin(places(spark, d), lots(spark, d), 150.0, SIZE)


@REGISTRY.add(
    "geo_assigned",
    """WITH f AS (SELECT point, min(polygon) AS polygon, 'inside' AS how FROM lot_points GROUP BY point),
    n AS (SELECT point, polygon, 'near' AS how FROM lot_near WHERE d <= 15 AND point NOT IN (SELECT point FROM f) QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, polygon) = 1)
    SELECT point, polygon, how FROM places LEFT JOIN (SELECT * FROM f UNION ALL SELECT * FROM n) USING (point)""",
    "lot_points lot_near",
)
def _(spark, d):
    return P.assigned(places(spark, d), lots(spark, d), 15.0, SIZE).select("point", "polygon", "how")


@REGISTRY.add(
    "geo_nearest_in_turn",
    """WITH c AS (SELECT point, station AS target, round(sqrt(power(p.x - s.x, 2) + power(p.y - s.y, 2)), 6) AS d FROM places p JOIN stations s ON abs(p.x - s.x) <= 1500 AND abs(p.y - s.y) <= 1500)
    SELECT point, target, d, CASE WHEN d <= 150 THEN 150.0 ELSE 1500.0 END::DOUBLE AS radius FROM c WHERE d <= 1500 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, target) = 1""",
    "places stations",
    "d radius",
)
def _(spark, d):
    return P.nearest_in_turn(places(spark, d), stations(spark, d).select(F.col("station").alias("target"), "x", "y"), [150.0, 1500.0])


@REGISTRY.add(
    "geo_projection",
    """WITH k AS (SELECT n, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) * 0.9996 AS r, 2 * sqrt(n) / (1 + n) AS w, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1,
        13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4
        FROM (SELECT (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n)),
    p AS (SELECT cusec, x / 85000 - 0.5::DOUBLE AS longitude, 39.3::DOUBLE + y / 111000 AS latitude FROM sections),
    t AS (SELECT p.*, k.*, sinh(atanh(sin(radians(latitude))) - w * atanh(w * sin(radians(latitude)))) AS t, radians(longitude + 3) AS o FROM p, k),
    e AS (SELECT *, atan2(t, cos(o)) AS xi, atanh(sin(o) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT cusec, 500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS x,
        r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS y, longitude, latitude FROM e""",
    "sections",
    "x y longitude latitude",
)
def _(spark, d):
    """To metres and back: longitude and latitude are what comes out again."""
    there = sections(spark, d).select("cusec", P.utm(F.col("x") / 85000 - 0.5, 39.3 + F.col("y") / 111000).alias("p"))
    back = P.degrees(F.col("p.x"), F.col("p.y"))
    return there.select("cusec", F.col("p.x").alias("x"), F.col("p.y").alias("y"), back["longitude"].alias("longitude"), back["latitude"].alias("latitude"))


@REGISTRY.add(
    "geo_interior_point",
    """WITH v AS (SELECT polygon, (max(ay) + min(ay)) / 2 AS mid FROM lot_sides WHERE polygon NOT IN (SELECT polygon FROM lots WHERE hole) GROUP BY polygon),
    l AS (SELECT polygon, (max(ay) FILTER (ay <= mid) + min(ay) FILTER (ay > mid)) / 2 AS level FROM v JOIN lot_sides USING (polygon) GROUP BY polygon),
    c AS (SELECT polygon, level, ax + (level - ay) * (bx - ax) / (by_ - ay) AS cx FROM l JOIN lot_sides USING (polygon) WHERE (ay > level) <> (by_ > level)),
    s AS (SELECT polygon, level, cx, lead(cx) OVER w AS nx, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY polygon ORDER BY cx))
    SELECT polygon, (cx + nx) / 2 AS px, level AS py FROM s WHERE i % 2 = 1 QUALIFY row_number() OVER (PARTITION BY polygon ORDER BY nx - cx DESC, cx) = 1""",
    "lots lot_sides",
    "px py",
)
def _(spark, d):
    rows = lots(spark, d)
    whole = rows.groupBy("polygon").count().where("count = 1").select("polygon")
    return P.interior_points(rows.join(whole, "polygon", "left_semi")).select("polygon", "px", "py")


def sheets(spark, d):
    key = F.col("l_orderkey")
    return read(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("sheet"), F.pmod(key * 31 + F.col("l_partkey"), F.lit(600)).alias("row"), F.pmod(key * 17 + F.col("l_suppkey"), F.lit(600)).alias("col"), F.col("l_quantity").alias("h")
    )


@REGISTRY.add(
    "geo_mosaic",
    """SELECT floor((l_linenumber * 100 + ((l_orderkey * 31 + l_partkey) % 600 + 0.5) * 1) / 3)::BIGINT AS row, floor((l_linenumber * 50 + ((l_orderkey * 17 + l_suppkey) % 600 + 0.5) * 1) / 3)::BIGINT AS col,
       max(l_quantity) AS h, count(DISTINCT l_linenumber) AS sheets FROM lineitem WHERE l_quantity BETWEEN 2 AND 40 GROUP BY 1, 2""",
    doubles="h",
)
def _(spark, d):
    origins = spark.createDataFrame([(i, i * 50.0, i * 100.0) for i in range(1, 8)], "sheet int, x0 double, y0 double")
    return P.mosaic(sheets(spark, d), origins, 1.0, 3.0)
