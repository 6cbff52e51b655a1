"""First quotas by load from counts in steps of the load: exact, and no sketch is made."""

from __future__ import annotations

import random

import pytest

from umbra.operators import regret as R


@pytest.mark.parametrize("bins", [1, 4, 512])
def test_bins_are_exact_with_ties_and_loads_beyond_the_steps(spark, bins):
    some = random.Random(bins)
    rows = [(case, f"{i:05d}", float(some.choice([some.randrange(1000), 7, 500, 1500])), float(i % 97)) for case, n in (("a", 2000), ("b", 11), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "rep string, cusec string, load double, true_load double")
    fractions = [0.001, 0.05, 0.25, 0.5, 1.0]
    want = {}
    for case in "abc":
        own = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[2], r[1]))
        for q in fractions:
            want[case, q] = sum(r[3] for r in own[: max(int(q * len(own)), 1)])
    assert {(r.rep, r.fraction): r.captured for r in R.selected_by_bins(frame, ["rep"], fractions, 1000.0, bins).collect()} == want
    assert R.selected_by_bins(frame, ["rep"], fractions, 1000.0, 1, most_ranked=500) is None


def test_replicates_of_regret_make_no_sketch(spark, monkeypatch):
    plans, staged = [], R.staged
    monkeypatch.setattr(R, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df))
    people = spark.createDataFrame([(f"{i:02d}", 10.0 + i % 7, True, (i % 5) / 5, (i % 3) / 3) for i in range(30)], "cusec string, pop double, reachable boolean, exposed_buildings double, exposed_full double")
    sums = spark.createDataFrame([(f"{i:02d}", f"d{j}", float((i + j) % 3), float(j % 2), 3) for i in range(30) for j in range(4)], "cusec string, date string, coarse double, local double, n long")
    drawn = spark.createDataFrame([(b, f"d{j}", 1 + (b + j) % 2) for b in range(3) for j in range(4)], "b long, date string, times long")
    got = R.regret_replicates(people, sums, drawn, [0.1, 0.5])
    assert got.count() == 5 * 2 * 3 and got.where("rep = 'R5' AND efficiency = 100").count() == 6
    assert plans and not any("percentile_approx" in p for p in plans)
