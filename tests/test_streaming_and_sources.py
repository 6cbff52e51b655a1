"""The streaming panel against the batch one, and readers on small files."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from umbra.operators.quality import plausible
from umbra.sources import readers, writers
from umbra.streaming.panel import hourly_stream


def test_stream_gives_the_batch_panel(spark, tmp_path):
    rows = [(s, datetime(2024, 6, 1) + timedelta(minutes=10 * i), float(i % 60)) for s in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "station string, ts timestamp, t double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = hourly_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("panel").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = plausible(df).groupBy("station", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("t_ok").alias("t"), F.count("t_ok").alias("n"))
    assert sorted(map(tuple, spark.table("panel").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_demography_with_decimal_commas(spark, tmp_path):
    text = "﻿Municipios;Secciones;Indicador;Periodo;Total\nX;4625001001 sec;age;2022;1.234,5\nX;4625001001 sec;age;2021;9\nX;4625001001 sec;people;2022;7\nX;;age;2022;1\nX;99 sec;age;2022;1\n"
    (tmp_path / "d.csv").write_text(text, encoding="utf-8")
    row = readers.demography(spark, str(tmp_path / "d.csv"), "46250").first()
    assert (row.cusec, row.age, row.people) == ("4625001001", 1234.5, 7.0)


def test_json_layers(spark, tmp_path):
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"name": "A"}}
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point]}))
    assert tuple(readers.geojson_points(spark, str(tmp_path / "p.json")).first()) == (1.5, 2.5, "A")
    elements = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    got = readers.map_elements(spark, str(tmp_path / "o.json")).orderBy("id").collect()
    assert [(r.lat, r.lon) for r in got] == [(1.0, 2.0), (3.0, 4.0)] and got[0].tags == {"a": "b"}


def test_graph_edges_from_xml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph><edge source="1" target="2"><data key="length">5.5</data><data key="name">x</data></edge></graph></graphml>')
    row = readers.graph_edges(spark, str(tmp_path / "g.graphml")).first()
    assert (row.u, row.v, row.data) == (1, 2, {"length": "5.5", "name": "x"})


def test_sorted_parquet_round_trip(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 0.5)
    writers.sorted_parquet(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("x")).first()[0] == 2475.0
