"""Operators on fixtures with known answers."""

from __future__ import annotations

import itertools
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from umbra.functions.stats import normal_cdf, spearman
from umbra.operators import decisions, policy, quality, resample, shelters


def readings(spark, values, step=10, station="s"):
    start = datetime(2024, 6, 1)
    return spark.createDataFrame([(station, start + timedelta(minutes=step * i), i, v) for i, v in enumerate(values)], "station string, ts timestamp, obs long, t double")


def test_sentinel_is_masked_before_spikes(spark):
    """24, 0, 24 is one sentinel, not two jumps; an isolated 40 among 24s is a spike."""
    got = quality.validated(readings(spark, [24.0, 24.0, 0.0, 24.0, 24.0, 24.0, 40.0, 24.0, 24.0])).orderBy("obs").collect()
    assert [r.out_of_range for r in got] == [i == 2 for i in range(9)]
    assert [r.spike for r in got] == [i == 6 for i in range(9)]
    assert [r.t_qc for r in got] == [24, 24, None, 24, 24, 24, None, 24, 24]


def test_null_readings_break_flat_runs(spark):
    got = quality.flat_runs(readings(spark, [20.0] * 12 + [None, None] + [21.0] * 3), 15, 12).first()
    assert got.longest_run == 12 and abs(got.flat_pct - 100 * 12 / 17) < 1e-9


def test_replicated_series_share_the_first_name(spark):
    rows = [(s, i, float(i % 7 + (s == "c"))) for s in "abc" for i in range(150)]
    got = quality.replicas(spark.createDataFrame(rows, "series string, ts long, t double"), 100)
    assert {r.series: r.group for r in got.collect()} == {"a": "a", "b": "a", "c": "c"}


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert spearman(df, "a", "b").first().rho is None
    df = spark.createDataFrame([(1.0, 9.0), (2.0, 8.0), (2.0, 8.0), (3.0, 1.0)], "a double, b double")
    assert abs(spearman(df, "a", "b").first().rho + 1) < 1e-12


def test_normal_cdf(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.959964)).alias("a"), normal_cdf(F.lit(0.0)).alias("b"), normal_cdf(F.lit(-1.0)).alias("c")).first()
    assert abs(row.a - 0.975) < 1e-6 and abs(row.b - 0.5) < 1e-6 and abs(row.c - 0.158655254) < 1e-6


def test_equal_scores_at_the_quota_boundary_go_by_key(spark):
    rows = [(f"{i:03d}", 1, 5.0, True, "x", 0.5) for i in (3, 1, 2, 0)]
    df = spark.createDataFrame(rows, "cusec string, district int, pop double, reachable boolean, rep string, frac double")
    assert [r.cusec for r in decisions.priority(df, ["rep"], 0.5).where("first").orderBy("cusec").collect()] == ["000", "001"]


def test_swap_costs_against_enumeration(spark):
    """The cheapest replacement of j selected sections costs what exhaustive search finds."""
    scores = [9.0, 7.0, 6.5, 6.0, 2.0, 1.0]
    rows = [("m", 1, f"{i}", s, True, 3, True, s, sum(scores[:3]), i < 3, i not in (1, 2, 5)) for i, s in enumerate(scores)]
    names = "mode string, year int, cusec string, local double, reachable boolean, k int, x boolean, regional double, opt_local double, top_local boolean, top_regional boolean"
    got = {r.tolerance: r for r in policy.swaps(spark.createDataFrame(rows, names), ["mode", "year"], [0.0, 0.05, 0.3]).collect()}
    for tolerance, row in got.items():
        best = {len(set(c) - {0, 1, 2}): max(sum(scores[i] for i in d) for d in itertools.combinations(range(6), 3) if len(set(d) - {0, 1, 2}) == len(set(c) - {0, 1, 2})) for c in itertools.combinations(range(6), 3)}
        assert row.max_swaps == sum(sum(scores[:3]) - best[j] <= tolerance * sum(scores[:3]) + 1e-8 for j in (1, 2, 3))


def test_common_list_bound_holds_against_enumeration(spark):
    import numpy as np

    scores = np.random.default_rng(4).random((8, 4)) * 50
    rows = [(f"{i}", "f", float(s), float(scores[i, s])) for i in range(8) for s in range(4)]
    got = policy.common_list(spark.createDataFrame(rows, "cusec string, field string, delta double, pct double"), 3, 6).collect()
    best = max(scores[list(c)].sum(axis=0).min() for c in itertools.combinations(range(8), 3))
    assert all(r.primal <= best + 1e-6 <= r.bound + 2e-6 for r in got)


def test_identity_replicates_give_the_point_estimate(spark):
    rows = spark.createDataFrame([("s", datetime(2024, 1, 1 + i).date(), float(i)) for i in range(9)], "station string, date date, v double")
    every = rows.select(F.lit(0).alias("b"), "date", F.lit(1).alias("times"))
    assert resample.replicated_means(resample.day_sums(rows, ["station"], "v"), every, ["station"]).first().value == 4.0
    drawn = resample.day_replicates(rows, 20).groupBy("b").agg(F.sum("times").alias("n")).collect()
    assert len(drawn) == 20 and all(r.n == 9 for r in drawn)


def test_blocks_fill_each_summer(spark):
    rows = spark.createDataFrame([(y, datetime(y, 6, 1 + i).date()) for y, n in ((2020, 20), (2021, 3)) for i in range(n)], "summer int, date date")
    got = resample.block_replicates(rows, 5, 7, "summer").groupBy("summer", "b").agg(F.sum("times").alias("n")).collect()
    assert {(r.summer, r.n) for r in got} == {(2020, 20), (2021, 3)} and len(got) == 10


def sites(spark):
    rows = [(1, True, [(9.0, 14.0), (16.0, 18.0)]), (2, True, [(10.0, 22.0)]), (3, False, [(9.0, 13.0)])]
    return spark.createDataFrame(rows, "site long, announced boolean, intervals array<struct<start:double,end:double>>")


def test_opening_intervals_are_half_open(spark):
    times = spark.createDataFrame([(x,) for x in (9.0, 14.0, 17.75, 18.0, 20.0, 21.0)], "moment double")
    got = {(r.site, r.policy, r.moment) for r in shelters.opened_at(shelters.policy_intervals(sites(spark)), times).collect()}
    assert (1, "ordinary", 9.0) in got and (1, "ordinary", 14.0) not in got and (1, "ordinary", 18.0) not in got
    assert (1, "event", 20.0) in got and (1, "event", 21.0) not in got and (2, "event", 21.0) in got
    assert (3, "event", 14.0) not in got and (3, "geographic", 14.0) in got
    stay = {(r.site, r.moment) for r in shelters.opened_at(shelters.policy_intervals(sites(spark)), times, 0.5).where("policy = 'ordinary'").collect()}
    assert (1, 17.75) not in stay


def test_extension_cost_on_quarter_hours(spark):
    assert {r.site: r.cost for r in shelters.extension_cost(sites(spark)).collect()} == {1: 3.0, 2: 0.0, 3: 8.0}


def test_greedy_is_within_the_optimum_and_the_budget(spark):
    patterns = spark.createDataFrame([("m", [1, 2], 10.0), ("m", [2], 4.0), ("m", [3], 9.0), ("m", [1], 3.0)], "movement string, pattern array<bigint>, weight double")
    costs = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 3.0)], "site long, cost double")
    budgets = spark.createDataFrame([("m", 5.0)], "movement string, budget double")
    got = shelters.greedy(patterns, costs, budgets, 5).orderBy("round").collect()
    assert [(r.site, r.spent) for r in got] == [(2, 2.0), (3, 5.0)] and sum(r.gain for r in got) == 23.0


def test_shadow_of_a_tall_block_under_a_sun_at_45_degrees(spark):
    """30 m high, sun at 45 degrees, cells of 3 m: nine cells away from the sun, in four directions."""
    from umbra.operators import shade

    cells = spark.createDataFrame([(50, 50, 30.0)], "row int, col int, h double")
    suns = spark.createDataFrame([("n", 45.0, 0.0), ("e", 45.0, 90.0), ("s", 45.0, 180.0), ("w", 45.0, 270.0)], "sun string, elevation double, azimuth double")
    got = {}
    for r in shade.shaded_cells(cells, suns, 3.0, 101, 101).collect():
        got.setdefault(r.sun, set()).add((r.row, r.col))
    away = {"n": (1, 0), "e": (0, -1), "s": (-1, 0), "w": (0, 1)}
    for sun, (dr, dc) in away.items():
        assert got[sun] in ({(50 + dr * n, 50 + dc * n) for n in range(1, m)} for m in (10, 11)), sun


def test_rings(spark):
    from umbra.operators import geometry

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, square, 7.0), (2, [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)], 9.0)], "feature int, ring array<struct<x:double,y:double>>, h double")
    row = df.where("feature = 1").select(geometry.signed_area(F.col("ring")).alias("a"), geometry.centroid(F.col("ring")).alias("c"), geometry.inside(F.col("ring"), F.lit(1.0), F.lit(1.0)).alias("i"), geometry.inside(F.col("ring"), F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (row.a, row.c.x, row.c.y, row.i, row.o) == (16.0, 2.0, 2.0, True, False)
    cells = {(r.row, r.col): r.h for r in geometry.cells_inside(df, 2.0).collect()}
    assert cells[0, 0] == 7.0 and cells[1, 1] == 9.0 and len(cells) == 12
