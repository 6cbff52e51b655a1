"""Layers and filters: tables are written in a map format and read back by its reader; reports of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import audit as A
from umbra.operators import filters as L
from umbra.operators import geometry as G
from umbra.operators import shade as S
from umbra.operators import spatial as P
from umbra.plans.inputs import REGISTRY, read, sections
from umbra.plans.network_plans import edges, nodes
from umbra.plans.policy_plans import grid
from umbra.plans.shade_plans import buildings
from umbra.plans.spatial_plans import lots
from umbra.sources import readers
from umbra.sources.staging import shared_path


def _features(rows, geometry, properties):
    """A document with one feature for each row."""
    return rows.select(F.lit("FeatureCollection").alias("type"), F.array(F.struct(geometry.alias("geometry"), properties.alias("properties"))).alias("features"))


def _xml(rows, key, root: str, path: str) -> None:
    """Elements (``value``) as files below ``path`` of up to 500 of them, each a document with ``root``."""
    files = rows.groupBy(F.floor(F.col(key) / 500).alias("file")).agg(F.array_join(F.collect_list("value"), "").alias("elements"))
    name = root.split()[0]
    files.select("file", F.concat(F.lit(f"<{root}>"), "elements", F.lit(f"</{name}>")).alias("value")).write.partitionBy("file").text(path)


@REGISTRY.add("src_geojson_points", "SELECT x / 85000 AS lon, 39 + y / 111000 AS lat, 'Site ' || cusec AS name FROM sections", "sections", "lon lat")
def _(spark, d):
    path = shared_path(spark, "points")
    place = F.struct(F.lit("Point").alias("type"), F.array(F.col("x") / 85000, 39 + F.col("y") / 111000).alias("coordinates"))
    _features(sections(spark, d), place, F.struct(F.concat(F.lit("Site "), "cusec").alias("name"))).write.json(path)
    return readers.geojson_points(spark, path, lines=True)


@REGISTRY.add(
    "src_map_elements",
    """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'way' ELSE 'node' END AS type, p_partkey AS id, 39 + p_size / 100 AS lat, p_retailprice / 10000 AS lon, p_size::VARCHAR || ' m' AS height FROM part""",
    doubles="lat lon",
)
def _(spark, d):
    """Ways have a centre, nodes a position; the height is a tag."""
    path = shared_path(spark, "elements")
    lat, lon, way = 39 + F.col("p_size") / 100, F.col("p_retailprice") / 10000, F.pmod("p_partkey", F.lit(3)) == 0
    element = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), F.col("p_partkey").alias("id"), F.when(~way, lat).alias("lat"), F.when(~way, lon).alias("lon"),
        F.when(way, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), F.create_map(F.lit("height"), F.concat(F.col("p_size").cast("string"), F.lit(" m"))).alias("tags"),
    )
    read(spark, d, "part").select(F.array(element).alias("elements")).write.json(path)
    return readers.map_elements(spark, path, lines=True).select("type", "id", "lat", "lon", F.element_at("tags", "height").alias("height"))


@REGISTRY.add("src_graphml_edges", "SELECT u, v, length FROM edges", "edges", "length")
def _(spark, d):
    path = shared_path(spark, "graphml")
    data = F.concat(F.lit('<data key="length">'), F.col("length").cast("string"), F.lit('</data><data key="kind">street</data>'))
    rows = edges(spark, d).select(F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('">'), data, F.lit("</edge>")).alias("value"), "u")
    _xml(rows, "u", "graph", path)
    return readers.graph_edges(spark, path).select("u", "v", F.element_at("data", "length").try_cast("double").alias("length"))


@REGISTRY.add("src_graphml_nodes", "SELECT node, x, y FROM nodes", "nodes", "x y")
def _(spark, d):
    path = shared_path(spark, "graphml")
    text = lambda c: F.col(c).cast("string")
    rows = nodes(spark, d).select(F.concat(F.lit('<node id="'), text("node"), F.lit('"><data key="x">'), text("x"), F.lit('</data><data key="y">'), text("y"), F.lit("</data></node>")).alias("value"), "node")
    _xml(rows, "node", "graph", path)
    number = lambda k: F.element_at("data", k).try_cast("double").alias(k)
    return readers.graph_nodes(spark, path).select("node", number("x"), number("y"))


_PLACES = "srsDimension=\"2\""


@REGISTRY.add(
    "src_building_parts",
    """SELECT polygon, any_value(polygon::INTEGER % 12 + 1)::INTEGER AS floors, count(*) AS corners, sum(ax * by_ - bx * ay) / 2 AS area FROM lot_sides GROUP BY polygon""",
    "lot_sides",
    "area",
)
def _(spark, d):
    """Lots as parts of buildings, holes as inner rings."""
    path = shared_path(spark, "gml")
    place = F.array_join(F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), " ")
    ring = F.concat(F.lit(f"<gml:LinearRing><gml:posList {_PLACES}>"), place, F.lit("</gml:posList></gml:LinearRing>"))
    rows = lots(spark, d).withColumn("gml", ring).withColumn("area", G.signed_area(F.col("ring"))).groupBy("polygon").agg(F.sort_array(F.collect_list(F.struct("area", "gml")), asc=False).alias("rings"))
    inner = F.array_join(F.transform(F.slice("rings", 2, 10), lambda r: F.concat(F.lit("<gml:interior>"), r["gml"], F.lit("</gml:interior>"))), "")
    patch = F.concat(F.lit("<gml:PolygonPatch><gml:exterior>"), F.get("rings", F.lit(0))["gml"], F.lit("</gml:exterior>"), inner, F.lit("</gml:PolygonPatch>"))
    floors = (F.pmod(F.col("polygon").cast("int"), F.lit(12)) + 1).cast("string")
    part = F.concat(
        F.lit('<bu:BuildingPart gml:id="'), "polygon", F.lit('"><bu:geometry><gml:Surface><gml:patches>'), patch, F.lit("</gml:patches></gml:Surface></bu:geometry><bu:numberOfFloorsAboveGround>"),
        floors, F.lit("</bu:numberOfFloorsAboveGround></bu:BuildingPart>"),
    )
    _xml(rows.select(part.alias("value"), F.col("polygon").cast("int").alias("key")), "key", 'layer xmlns:bu="urn:bu" xmlns:gml="urn:gml"', path)
    found = readers.building_parts(spark, path, "BuildingPart")
    return found.groupBy("polygon").agg(F.max("floors").alias("floors"), F.sum(F.size("ring")).alias("corners"), F.sum(G.signed_area(F.col("ring"))).alias("area"))


@REGISTRY.add(
    "src_polygon_layer",
    "SELECT cusec AS polygon, district, pop, 4::BIGINT AS corners, true AS near FROM sections WHERE reachable",
    "sections",
    "pop",
)
def _(spark, d):
    """Squares of 0.001 degrees; only those of reachable sections are known. ``near``: the first corner comes back to where it was, within a tenth of a millimetre."""
    path = shared_path(spark, "layer")
    x, y = F.col("x") / 85000 - 0.5, 39.3 + F.col("y") / 111000
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(0.001, 0), corner(0.001, 0.001), corner(0, 0.001))).alias("coordinates"))
    _features(sections(spark, d), shape, F.struct(F.col("cusec").alias("CUSEC"))).write.json(path)
    known = sections(spark, d).where("reachable").select(F.col("cusec").alias("polygon"), "district", "pop", x.alias("lon"), y.alias("lat"))
    rings = readers.known_polygons(readers.geojson_polygons(spark, path, "CUSEC", lines=True), known)
    back = P.degrees(F.get("ring", F.lit(0))["x"], F.get("ring", F.lit(0))["y"])
    near = (F.abs(back["longitude"] - F.col("lon")) < 1e-9) & (F.abs(back["latitude"] - F.col("lat")) < 1e-9)
    return rings.select("polygon", "district", "pop", F.size("ring").cast("long").alias("corners"), near.alias("near"))


@REGISTRY.add(
    "src_scenario_scores",
    """SELECT mode, field, delta, count(*) AS rows, (count(*) - count(DISTINCT cusec))::BIGINT AS repeated, (any_value(n) - count(DISTINCT cusec))::BIGINT AS missing, count(*) = count(DISTINCT cusec) AND any_value(n) = count(DISTINCT cusec) AS aligned
       FROM grid JOIN (SELECT mode, count(DISTINCT cusec) AS n FROM grid GROUP BY mode) USING (mode) GROUP BY ALL""",
    "grid",
    "delta",
)
def _(spark, d):
    path = shared_path(spark, "scenarios")
    grid(spark, d).select("mode", "field", "delta", "cusec", "score").write.parquet(path)
    return readers.scenario_scores(spark, path)[1]


@REGISTRY.add("aud_manifest", "SELECT (length(r_name) + 1)::BIGINT AS length, sha256(r_name || chr(10)) AS sha256 FROM region")
def _(spark, d):
    """A file with the name of each region."""
    path = shared_path(spark, "files")
    read(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(path)
    return A.manifest(spark, path).select("length", "sha256")


@REGISTRY.add(
    "aud_report",
    """WITH c AS (SELECT district, count(*) > 20 AND min(pop) >= 0 AS passed, count(*) AS sections, sum(pop) AS people FROM sections GROUP BY district)
    SELECT CASE WHEN count_if(NOT passed) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS checks, count_if(NOT passed)::BIGINT AS failed, min(sections) AS least_sections, max(sections) AS largest_sections, min(people) AS least_people, max(people) AS largest_people FROM c""",
    "sections",
    "least_people largest_people",
)
def _(spark, d):
    checks = sections(spark, d).groupBy("district").agg(((F.count("*") > 20) & (F.min("pop") >= 0)).alias("passed"), F.count("*").alias("sections"), F.sum("pop").alias("people"))
    return A.report(checks, ["sections", "people"])


@REGISTRY.add(
    "shd_floor_metres",
    """SELECT b AS band, count(*) AS n, quantile_cont((h_p75 - 1) / floors, 0.25) AS q1, quantile_cont((h_p75 - 1) / floors, 0.5) AS q2, quantile_cont((h_p75 - 1) / floors, 0.75) AS q3, avg(3.0 * floors + 1 - h_p75) AS bias,
        avg(abs(3.0 * floors + 1 - h_p75)) AS mae, sqrt(avg(power(3.0 * floors + 1 - h_p75, 2))) AS rmse
       FROM (SELECT *, band AS b FROM buildings UNION ALL SELECT *, 'all' AS b FROM buildings) WHERE floors > 0 AND h_p75 IS NOT NULL GROUP BY b""",
    "buildings",
    "q1 q2 q3 bias mae rmse",
)
def _(spark, d):
    return S.floor_metres(buildings(spark, d), "h_p75")


@REGISTRY.add(
    "flt_scope",
    """SELECT cusec, CASE WHEN cusec LIKE '00000%' THEN 'municipal' WHEN sqrt(x * x + y * y) / 1000 < 12 THEN 'metropolitan' ELSE 'periurban' END AS scope FROM sections""",
    "sections",
)
def _(spark, d):
    return sections(spark, d).select("cusec", L.scope(F.col("cusec"), F.hypot("x", "y") / 1000, "00000").alias("scope"))


@REGISTRY.add("flt_named", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(coalesce(html, '')), 'ambulatori|salut|<title>[^<]*th')")
def _(spark, d):
    return L.named(read(spark, d, "pages"), "html", "(ambulatori|salut|<title>[^<]*th)").select("page_id", "url")


@REGISTRY.add("flt_column", "SELECT s_name AS label, s_suppkey AS site, NULL::VARCHAR AS kind FROM supplier")
def _(spark, d):
    """The column of names is found by its own name; one that isn't there is null."""
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return L.renamed_by(L.renamed_by(L.renamed_by(rows, "nom|name", "label"), "tipo|type", "kind", required=False), "suppkey", "site")


@REGISTRY.add(
    "flt_rings",
    """SELECT polygon FROM lots WHERE polygon::INTEGER % 4 > 1 AND x <= 12000 AND x + 4 * s >= 3000 AND y <= 15000 AND y + 4 * s >= 5000""",
    "lots",
)
def _(spark, d):
    """Rings that are none in two lots of four, then those whose box meets a window."""
    kind = F.pmod(F.col("polygon").cast("int"), F.lit(4))
    broken = F.when(kind == 0, F.slice("ring", 1, 2)).when(kind == 1, F.transform("ring", lambda p: F.struct(p["x"].alias("x"), F.lit(None).cast("double").alias("y")))).otherwise(F.col("ring"))
    rows = L.boxed(L.usable_rings(lots(spark, d).withColumn("ring", broken)))
    return L.meeting_box(rows, 3000.0, 5000.0, 12000.0, 15000.0).where("x1 - x0 > 150 and y1 - y0 > 150").select("polygon")
