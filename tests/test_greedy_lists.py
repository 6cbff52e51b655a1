"""Greedy lists go on until no offer fits."""

from __future__ import annotations

import pytest

from umbra.operators import shelters


def frames(spark):
    patterns = spark.createDataFrame([("m", [i], 20.0 - i) for i in range(1, 10)], "movement string, pattern array<bigint>, weight double")
    return patterns, spark.createDataFrame([(i, 1.0) for i in range(1, 10)], "site long, cost double")


def test_greedy_stops_when_nothing_fits_and_takes_budgets_as_keys(spark):
    budgets = spark.createDataFrame([("m", 0.25, 2.0), ("m", 1.0, 8.0)], "movement string, fraction double, budget double")
    got = shelters.greedy(*frames(spark), budgets).collect()
    assert sorted((r.fraction, r.round, r.site) for r in got) == [(0.25, i, i) for i in (1, 2)] + [(1.0, i, i) for i in range(1, 9)]


def test_greedy_raises_at_the_bound(spark):
    with pytest.raises(RuntimeError):
        shelters.greedy(*frames(spark), spark.createDataFrame([("m", 8.0)], "movement string, budget double"), 3)
    assert shelters.greedy(*frames(spark), spark.createDataFrame([("m", 3.0)], "movement string, budget double"), 3).count() == 3


def test_registered_cases_are_all_there(spark):
    from umbra.plans import shelter_plans

    assert len(shelter_plans.WALKS) == 9 and shelter_plans.FRACTIONS == [0.25, 0.5, 1.0]
