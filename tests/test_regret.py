from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from umbra.operators import network as N
from umbra.operators import regret as R
from umbra.operators import shade as S


@pytest.mark.parametrize("accuracy", [10, 50, 100_000])
def test_selected_load_is_exact_with_ties(spark, accuracy):
    some = random.Random(accuracy)
    rows = [(case, f"{i:05d}", float(some.choice([some.randrange(1000), 7, 500])), float(i % 97)) for case, n in (("a", 2000), ("b", 11), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "rep string, cusec string, load double, true_load double")
    fractions = [0.001, 0.05, 0.25, 0.5]
    want = {}
    for case in "abc":
        own = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[2], r[1]))
        for q in fractions:
            want[case, q] = sum(r[3] for r in own[: max(int(q * len(own)), 1)])
    got = {(r.rep, r.fraction): r.captured for r in R.selected_load(frame, ["rep"], fractions, accuracy).collect()}
    assert got == want


def test_levels_gate_by_shade(spark):
    rows = [("a", 10.0, True, 0.5, 0.8, 0.3, 0.2), ("b", 20.0, True, 0.5, 0.8, 0.6, 0.4), ("c", 5.0, True, 0.5, 0.8, None, 0.9), ("d", 9.0, False, 1.0, 1.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "cusec string, pop double, reachable boolean, coarse double, local double, exposed_buildings double, exposed_full double")
    got = {(r.cusec, r.rep): r.frac for r in R.information_levels(frame).collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", "R1"): 0.5, ("b", "R2"): 0.5, ("b", "R3"): 0.8, ("b", "R4"): 0.0, ("b", "R5"): 0.8}
    assert [got["c", f"R{i}"] for i in range(1, 6)] == [0.5, 0.0, 0.8, 0.0, 0.0] and ("d", "R1") not in got


def test_windows_need_all_their_hours(spark):
    routes = [(11, 0.0, 1, 10.0, 5.0), (11, 1.0, 1, 14.0, 2.0), (14, 0.0, 1, 16.0, 4.0), (11, 0.0, 2, 0.0, 0.0), (14, 0.0, 2, 0.0, 0.0)]
    frame = spark.createDataFrame(routes, "hour int, weight double, node int, t double, sun double")
    cases = spark.createDataFrame([(1.0, 15.0, 1.0), (1.0, 20.0, 1.0)], "speed double, budget double, factor double")
    got = {(r.node, r.budget, r.window): (r.reachable, r.exposed) for r in R.window_exposure(frame, cases, {"early": [11], "both": [11, 14]}).collect()}
    assert got[1, 15.0, "early"] == (True, 2 / 14) and got[1, 15.0, "both"] == (False, 2 / 14)
    assert got[1, 20.0, "both"] == (True, (2 / 14 + 4 / 16) / 2) and got[2, 15.0, "both"] == (True, None)
    people = spark.createDataFrame([(1, 30.0), (2, 10.0)], "node int, pop double")
    grid = {(r.budget, r.window): (r.n, r.people_pct, r.fails, r.regime) for r in R.dominance_grid(people, R.window_exposure(frame, cases, {"early": [11], "both": [11, 14]}), [0.5], 0.15).collect()}
    assert grid[15.0, "both"] == (1, 25.0, 0, "heat") and grid[20.0, "both"] == (2, 100.0, 1, "sun")


@pytest.mark.parametrize("merge_rounds", [1, 3, 50])
def test_paths_do_not_depend_on_merging(spark, merge_rounds):
    some = random.Random(4)
    edges = [(i, i + 1, 1.0 + some.random()) for i in range(30)] + [(i, i + 7, 4.0 + 3 * some.random()) for i in range(24)]
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    far = {0: 0.0, 29: 0.0}
    for _ in range(40):
        for a, b, w in both:
            if a in far and far[a] + w < far.get(b, 1e9):
                far[b] = far[a] + w
    frame = spark.createDataFrame([(a, b, w, w, 0.0) for a, b, w in both], "u int, v int, cost double, t double, sun double")
    got = {r.node: r.cost for r in N.relax(frame, spark.createDataFrame([(0,), (29,)], "node int"), merge_rounds=merge_rounds).collect()}
    assert got.keys() == far.keys() and all(abs(got[k] - far[k]) < 1e-9 for k in far)


def test_one_cast_answers_for_all_factors(spark):
    some = random.Random(2)
    cells = spark.createDataFrame([(some.randrange(40), some.randrange(40), some.randrange(1, 30) + 0.5) for _ in range(60)], "row int, col int, h double").groupBy("row", "col").agg(F.max("h").alias("h"))
    suns = spark.createDataFrame([("a", 30.0, 100.0), ("b", 60.0, 200.0), ("low", 4.0, 90.0)], "sun string, elevation double, azimuth double")
    least = S.least_factors(cells, suns, 3.0, 40, 40, 1.5)
    for factor in (0.5, 1.0, 1.5):
        cast = S.shaded_cells(cells.withColumn("h", F.col("h") * factor), suns, 3.0, 40, 40)
        assert {tuple(r) for r in least.where(F.col("least") < factor).select("sun", "row", "col").collect()} == {tuple(r) for r in cast.collect()}
