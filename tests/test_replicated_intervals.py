"""Intervals of replicated means come from an array of each unit, and its days are shuffled once."""

from __future__ import annotations

import random

from umbra.operators import resample as B
from umbra.plans import decision_plans as D


def test_intervals_equal_those_over_rows_and_no_replicate_is_shuffled(spark):
    dice = random.Random(5)
    days = [(s, f"d{i:02d}", dice.random() - 0.4, 1 + i % 3) for s in "abcd" for i in range(12) if (s, i) != ("a", 3) and (s != "d" or i == 0)]
    sums = spark.createDataFrame(days, "station string, date string, total double, n long")
    drawn = B.day_replicates(sums, 60)
    want = {tuple(r) for r in B.intervals(B.replicated_means(sums, drawn, ["station"]), ["station"]).selectExpr("station", "round(low, 9)", "round(middle, 9)", "round(high, 9)", "reps", "significant").collect()}
    got = B.replicated_intervals(sums, drawn, ["station"])
    assert {tuple(r) for r in got.selectExpr("station", "round(low, 9)", "round(middle, 9)", "round(high, 9)", "reps", "significant").collect()} == want and len(want) == 4
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(station" in line]
    assert len(dealt) == 1 and "pack" not in dealt[0] and "Generate" not in plan, plan


def test_blocks_read_the_panel_once(spark, monkeypatch):
    reads, days = [], D.days
    monkeypatch.setattr(D, "days", lambda spark, d: reads.append(d) or days(spark, d))
    D.blocks(spark, "/root/testdata/sf0.001", [1, 7])
    assert len(reads) == 1
