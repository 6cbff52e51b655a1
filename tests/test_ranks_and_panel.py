from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.functions.ranks import value_ranks
from umbra.operators import decisions as D
from umbra.operators import panel as P


@pytest.mark.parametrize("parts", [1, 7, None])
def test_ranks_of_values(spark, parts):
    some = random.Random(1)
    values = [some.choice([some.random(), 0.5, 0.25]) for _ in range(500)]
    counts = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").agg(F.count("*").alias("n"))
    got = {r.x: r["rank"] for r in value_ranks(counts, "x", parts=parts).collect()}
    ordered = sorted(values)
    assert got == {v: statistics.mean(i + 1 for i, w in enumerate(ordered) if w == v) for v in set(values)}


def test_mann_whitney_counts_pairs(spark):
    some = random.Random(2)
    rows = [(float(some.randrange(20)), some.random() < 0.3) for _ in range(300)] + [(None, True)]
    got = D.mann_whitney(spark.createDataFrame(rows, "x double, f boolean"), "x", "f").first()
    a, b = [x for x, f in rows if f and x is not None], [x for x, f in rows if not f]
    assert got.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and (got.n1, got.n2) == (len(a), len(b))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_leaving_each_station_out(spark, least):
    some = random.Random(least)
    rows = [(s, f"2024-06-{1 + h // 24:02d}", h % 24, round(some.uniform(10, 35), 1)) for s in range(6) for h in range(60) if some.random() < (0.3 if s < 2 else 0.7)] + [(6, "2024-07-01", 0, 20.0)]
    panel = spark.createDataFrame(rows, "station int, date string, hour int, t double")
    got = {r.without: r for r in P.leave_one_out(panel, spark.createDataFrame([(s,) for s in range(8)], "station int"), least).collect()}
    for without in range(8):
        instants = {}
        for s, d, h, t in rows:
            if s != without:
                instants.setdefault((d, h), {})[s] = t
        instants = {k: v for k, v in instants.items() if len(v) >= least}
        spread = [np.quantile(list(v.values()), 0.9) - np.quantile(list(v.values()), 0.1) for v in instants.values()]
        off = {}
        for v in instants.values():
            middle = statistics.median(v.values())
            for s, t in v.items():
                off.setdefault(s, []).append(t - middle)
        means = {s: round(statistics.mean(x), 9) for s, x in off.items()}
        r = got[without]
        assert r.instants == len(instants) and abs(r.dispersion - statistics.mean(spread)) < 1e-9
        assert r.hottest == min(means, key=lambda s: (-means[s], s)) and r.coldest == min(means, key=lambda s: (means[s], s))
