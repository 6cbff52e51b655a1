"""The nearest stations are found in cells around, ties at the last one included."""

from __future__ import annotations

import math
import random

import pytest

from umbra.operators import fields as L


@pytest.mark.parametrize(("n", "k"), [(200, 4), (30, 8), (5, 8)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, n, k):
    random.seed(n)
    at = lambda: (float(random.randrange(0, 1000, 20)), float(random.randrange(0, 1000, 20)))
    stations = [(i, *at()) for i in range(n)] + [(n, *[500.0] * 2), (n + 1, *[500.0] * 2)]
    homes = [(f"c{i}", *at()) for i in range(40)] + [("far", 9e4, -9e4)]
    met, every = [], L.distances
    monkeypatch.setattr(L, "distances", lambda some, others: met.append(some.count()) or every(some, others))
    got = L.nearest(spark.createDataFrame(homes, "cusec string, x double, y double"), spark.createDataFrame(stations, "station long, x double, y double"), k)
    got = {(r.cusec, r.station): r.d for r in got.collect()}
    want = {}
    for name, x, y in homes:
        far = {s: math.hypot(x - sx, y - sy) for s, sx, sy in stations}
        last = sorted(far.values())[min(k, len(far)) - 1]
        want |= {(name, s): pytest.approx(d) for s, d in far.items() if d <= last}
    assert got == want
    assert met == [1 if n == 200 else met[0]]  # all but the far one are found in cells
