"""Top lists of scenarios come from brackets, without a scenario sorted."""

from __future__ import annotations

import random

import pytest

from umbra.operators import policy


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_cuts_are_those_of_whole_rankings(spark, accuracy):
    some = random.Random(accuracy)
    rows = [(mode, "local", delta, f"{i:05d}", some.choice([0.0, 0.0, 3.0, some.random(), None]) if delta else 0.0) for mode, n in (("a", 1500), (None, 40), ("c", 1)) for delta in (0.0, 1.0) for i in range(n)]
    frame = spark.createDataFrame(rows, "mode string, field string, delta double, cusec string, score double")
    keys = ["mode", "field", "delta"]
    for r in policy.cuts(frame, keys, 0.15, accuracy).collect():
        own = sorted((-(x[4] if x[4] is not None else float("-inf")), x[3]) for x in rows if (x[0], x[2]) == (r.mode, r.delta))
        top = own[: max(int(len(own) * 0.15), 1)]
        assert (r.k, r.low) == (len(top), -top[-1][0]) and abs(r.best - sum(-v for v, _ in top if v != float("inf"))) < 1e-9
        assert r.last in (top[-1][1], None) and (r.last is not None or all(v != top[-1][0] for v, _ in own[len(top) :]))
    got = policy.normalised(frame, ["mode"], 0.15)
    assert got.where("top").count() == 2 * (225 + 6 + 1) and "Window" not in policy.normalised(frame, ["mode"], 0.15, ties=False)._jdf.queryExecution().toString()


def test_scores_of_shifts_are_counted_before_they_are_repeated(spark):
    rows = [("m", "s", 8.0, 0.5, -1.0), ("m", "s", 8.0, -0.5, None), ("m", "t", 3.0, None, None)]
    frame = spark.createDataFrame(rows, "mode string, cusec string, pop double, local_margin double, regional_margin double")
    got = {(r.cusec, r.field, r.delta): r.score for r in policy.shifted_scores(frame, [-1, 0, 1], ["mode"]).collect()}
    assert got == {
        ("s", "local", -1.0): 0.0, ("s", "local", 0.0): 4.0, ("s", "local", 1.0): 8.0, ("s", "regional", -1.0): 0.0, ("s", "regional", 0.0): 0.0, ("s", "regional", 1.0): 8.0,
        **{("t", f, x): None for f in ("local", "regional") for x in (-1.0, 0.0, 1.0)},
    }
    assert policy.shifted_scores(frame, [0], ["mode"])._jdf.queryExecution().logical().toString().count("Aggregate") == 0
