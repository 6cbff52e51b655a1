"""The uniform field of sections from the field of their places."""

from __future__ import annotations

import random

from umbra.operators import fields as L


def test_places_with_counts_equal_sections_and_fields_stay_with_their_instant(spark):
    dice = random.Random(8)
    pairs = spark.createDataFrame([(p, s, dice.random() + 0.1) for p in range(6) for s in range(5) if (p + s) % 3], "cusec long, station long, w double")
    readings = spark.createDataFrame([(s, f"d{i % 3}", i % 4, dice.random() * 9 + 20) for s in range(5) for i in range(12) if (s + i) % 5], "station long, date string, hour int, t double")
    counts = spark.createDataFrame([(p, 1 + p % 4) for p in range(6)], "cusec long, n long")
    places = L.field(pairs, readings)
    every = places.join(counts, "cusec").selectExpr("explode(sequence(1, n)) AS i", "cusec", "date", "hour", "t").selectExpr("concat(cusec, '-', i) AS cusec", "date", "hour", "t")
    assert every.count() > places.count()
    want = {(r.date, r.hour): (round(r.t_uniform, 9), round(r.t_day, 9)) for r in L.uniform(every).collect()}
    got = L.uniform_of_places(places, counts)
    assert {(r.date, r.hour): (round(r.t_uniform, 9), round(r.t_day, 9)) for r in got.collect()} == want and len(want) > 6
    plan = places._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(date" in plan, plan
