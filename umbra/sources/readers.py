"""Readers of the file formats that inputs come in. Keys are always read as text; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.spatial import reprojected


def observations(spark: SparkSession, root: str, months: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Parquet partitioned by year and month: only the months asked for are listed and only the columns read."""
    return spark.read.parquet(root).where(F.col("month").isin(*months)).select(*columns)


def table_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header and perhaps a byte-order mark; header and values are trimmed."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def decimal_comma(text: Column) -> Column:
    """1.234,5 as a number; what is none becomes null."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def demography(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A long demography file as a row per section."""
    schema = "municipality string, section string, indicator string, period string, total string"
    return wide_demography(table_csv(spark, path, schema, ";"), prefix)


def wide_demography(rows: DataFrame, prefix: str, indicators: Sequence[str] | None = None) -> DataFrame:
    """Long demography as a row per section: the latest period, sections of one municipality, indicators as columns.

    Naming the ``indicators`` saves a pass that finds them.
    """
    rows = rows.where("trim(section) <> ''").withColumn("cusec", F.split(F.trim("section"), r"\s+")[0])
    rows = rows.where(F.col("cusec").startswith(prefix))
    last = rows.agg(F.max("period").alias("period"))
    names = list(indicators) if indicators else None
    return rows.join(F.broadcast(last), "period").groupBy("cusec").pivot("indicator", names).agg(F.min(decimal_comma(F.col("total"))))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents with the file each came from."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """JSON of a known shape: whole files, or a document on each line, which can be read by many tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def geojson_points(spark: SparkSession, path: str, name: str = "name", lines: bool = False) -> DataFrame:
    schema = f"features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<`{name}`:string>>>"
    features = _documents(spark, path, schema, lines).select(F.explode("features").alias("f"))
    points = features.where("f.geometry.type = 'Point'")
    return points.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties")[name].alias("name"))


def geojson_polygons(spark: SparkSession, path: str, key: str, lines: bool = False) -> DataFrame:
    """(polygon, ring) of all rings, outer and inner, of polygon features; ``key`` is the property with the id, x is longitude and y latitude."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<`{key}`:string>>>"
    features = _documents(spark, path, schema, lines).select(F.explode("features").alias("f")).where("f.geometry.type = 'Polygon'")
    rings = features.select(F.col("f.properties")[key].alias("polygon"), F.explode("f.geometry.coordinates").alias("ring"))
    return rings.select("polygon", F.transform("ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring"))


def known_polygons(rings: DataFrame, known: DataFrame, meridian: float = -3.0) -> DataFrame:
    """Rings of a layer in degrees, in metres, of the ids that ``known`` (polygon, attributes) has, with its attributes."""
    return reprojected(rings.join(known.select("polygon"), "polygon", "left_semi"), meridian).join(known, "polygon")


_RING = "struct<LinearRing:struct<posList:struct<_VALUE:string>>>"
_PART = f"_id string, numberOfFloorsAboveGround int, geometry struct<Surface:struct<patches:struct<PolygonPatch:array<struct<exterior:{_RING},interior:array<{_RING}>>>>>>"


def building_parts(spark: SparkSession, path: str, tag: str = "BuildingPart") -> DataFrame:
    """(polygon, floors, ring) of every ring of the building parts in GML files, outer and inner, coordinates as they stand.

    Elements are found by their tag and never held as one document; positions are a list of numbers, x and y in turn.
    """
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(_PART).load(path)
    patch = rows.select(F.col("_id").alias("polygon"), F.col("numberOfFloorsAboveGround").alias("floors"), F.explode("geometry.Surface.patches.PolygonPatch").alias("p"))
    inner = F.coalesce("p.interior", F.array().cast(f"array<{_RING}>"))
    rings = patch.select("polygon", "floors", F.explode(F.concat(F.array("p.exterior"), inner)).alias("r"))
    numbers = F.transform(F.split(F.trim("r.LinearRing.posList._VALUE"), r"\s+"), lambda t: t.try_cast("double"))
    pairs = rings.withColumn("n", numbers).where(F.size("n") >= 2)
    at = F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1)
    return pairs.select("polygon", "floors", F.transform(at, lambda i: F.struct(F.get("n", 2 * i).alias("x"), F.get("n", 2 * i + 1).alias("y"))).alias("ring"))


def scenario_scores(spark: SparkSession, path: str, by: Sequence[str] = ("mode",)) -> tuple[DataFrame, DataFrame]:
    """A long scenario table (by, field, delta, cusec, score), and for each scenario how it lines up with the others of its case.

    All scenarios of a case must have the same sections, once each: ``rows``, ``repeated``, ``missing`` of the case's sections, and ``aligned``.
    """
    rows = spark.read.schema(", ".join([*[f"{b} string" for b in by], "field string, delta double, cusec string, score double"])).parquet(path)
    each = rows.groupBy(*by, "field", "delta").agg(F.count("*").alias("rows"), F.count_distinct("cusec").alias("sections"))
    whole = rows.groupBy(*by).agg(F.count_distinct("cusec").alias("whole"))
    repeated, missing = F.col("rows") - F.col("sections"), F.col("whole") - F.col("sections")
    lined = each.join(whole, list(by)).select(*by, "field", "delta", "rows", repeated.alias("repeated"), missing.alias("missing"), ((repeated == 0) & (missing == 0)).alias("aligned"))
    return rows, lined


def map_elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements of a map extract: position or else that of the centre, and tags as a map."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    rows = _documents(spark, path, schema, lines).select(F.explode("elements").alias("e"))
    return rows.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags")


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GraphML file with their data keys as a map."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_key:string,_VALUE:string>>").load(path)
    return rows.select(F.col("_source").cast("long").alias("u"), F.col("_target").cast("long").alias("v"), F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data"))


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a GraphML file with their data keys as a map."""
    rows = spark.read.format("xml").option("rowTag", "node").schema("_id string, data array<struct<_key:string,_VALUE:string>>").load(path)
    return rows.select(F.col("_id").cast("long").alias("node"), F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data"))


def height_cells(cells: DataFrame, nodata: float) -> DataFrame:
    """Plausible heights above nothing: the sparse form of a raster."""
    h = F.col("h")
    return cells.where((h != nodata) & (h > -1) & (h < 250))


def complete_files(df: DataFrame, expected: int) -> DataFrame:
    """One row: how many files were read and whether it is the number expected."""
    files = df.select(F.col("_metadata.file_path").alias("file")).distinct()
    return files.agg(F.count("*").alias("files")).withColumn("complete", F.col("files") == expected)
