from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from umbra.operators import filters as L
from umbra.operators import shelters as S
from umbra.sources import readers


def made(seed: int):
    some = random.Random(seed)
    patterns = {}
    for _ in range(60):
        patterns[some.choice("abc"), tuple(sorted(some.sample(range(8), some.randrange(1, 4))))] = float(some.randrange(1, 50))
    return [(m, list(p), w) for (m, p), w in patterns.items()], {i: some.choice([0.5, 1.0, 2.0]) for i in range(8)}


def captures(patterns, chosen):
    whole, held = {}, {}
    for m, p, w in patterns:
        whole[m] = whole.get(m, 0) + w
        held[m] = held.get(m, 0) + (w if set(p) & set(chosen) else 0)
    return {m: 100 * held[m] / whole[m] for m in whole}


@pytest.mark.parametrize("seed", [1, 2])
def test_robust_programme_is_bounded_by_its_certificate(spark, seed):
    patterns, costs = made(seed)
    frame = spark.createDataFrame(patterns, "movement string, pattern array<bigint>, weight double")
    prices = spark.createDataFrame(list(costs.items()), "site long, cost double")
    references = frame.groupBy("movement").agg(F.sum("weight").alias("reference"))
    rows = S.robust_programme(frame, prices, references, 4.0).orderBy("step").collect()
    chosen = [r.site for r in rows]
    assert len(set(chosen)) == len(chosen) and abs(rows[-1].spent - sum(costs[i] for i in chosen)) < 1e-9 and rows[-1].spent <= 4.0
    for r in rows:
        assert abs(r.worst - min(captures(patterns, chosen[: r.step]).values())) < 1e-9
    best = max(min(captures(patterns, some).values()) for n in range(9) for some in itertools.combinations(range(8), n) if sum(costs[i] for i in some) <= 4.0)
    assert rows[-1].worst <= best + 1e-9 and best <= rows[-1].bound + 1e-9
    assert rows[-1].worst >= 0.6 * best and rows[-1].bound <= 1.35 * best
    assert all(a.bound >= b.bound for a, b in zip(rows, rows[1:]))
    assert S.robust_programme(frame.limit(0), prices, references.limit(0), 4.0).count() == 0


def test_least_hours_and_transfer_of_greedy_lists(spark):
    patterns, costs = made(5)
    frame = spark.createDataFrame(patterns, "movement string, pattern array<bigint>, weight double")
    prices = spark.createDataFrame(list(costs.items()), "site long, cost double")
    budgets = spark.createDataFrame([(m, 3.0) for m in "abc"], "movement string, budget double")
    lists, want = {}, {}
    for m in "abc":
        own, spent, steps, chosen = [x for x in patterns if x[0] == m], 0.0, [], []
        while True:
            gain = {i: sum(w for _, p, w in own if i in p and not set(p) & set(chosen)) for i in costs}
            fit = [i for i in costs if gain[i] > 0 and i not in chosen and spent + costs[i] <= 3.0]
            if not fit:
                break
            pick = max(fit, key=lambda i: (round(gain[i] / costs[i], 9), -i))
            chosen.append(pick)
            spent += costs[pick]
            steps.append((spent, gain[pick]))
        lists[m], whole = chosen, sum(g for _, g in steps)
        for share in (0.95, 0.99):
            n = next(k for k in range(1, len(steps) + 1) if sum(g for _, g in steps[:k]) >= share * whole - 1e-9)
            want[m, share] = (steps[n - 1][0], n)
    found = S.greedy(frame, prices, budgets)
    assert {(r.movement, r.share): (r.hours, r.rounds) for r in S.least_hours(found, ["movement"]).collect()} == want
    gained = {(m, of): sum(w for n, p, w in patterns if n == m and set(p) & set(lists[of])) for m in "abc" for of in "abc"}
    got = {r.movement: (r.gain, r.frozen_gain, r.capture_pct) for r in S.transfer(frame, found, "a").collect()}
    assert got == {m: pytest.approx((gained[m, m], gained[m, "a"], 100 * gained[m, "a"] / gained[m, m])) for m in "abc"}


def test_filters(spark):
    names = spark.createDataFrame([("Centre de Salut X",), ("CONSULTORI local",), ("Hospital",), (None,)], "Denominacio string")
    rows = L.renamed_by(names, "nom|denom|desc", "name")
    assert sorted(r["name"] for r in L.named(rows, "name", L.PRIMARY_CARE).collect()) == ["CONSULTORI local", "Centre de Salut X"]
    assert L.renamed_by(rows, "tipo|tipus", "kind", required=False).first()["kind"] is None
    ring = lambda *p: [{"x": x, "y": y} for x, y in p]
    shapes = [(1, ring((0.0, 0.0), (2.0, 0.0), (0.0, 2.0))), (2, ring((0.0, 0.0), (1.0, 1.0), (0.0, 0.0))), (3, None), (4, []), (5, ring((0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 1.0))), (6, ring((9.0, 9.0), (9.5, 9.0), (9.0, 9.5)))]
    usable = L.usable_rings(spark.createDataFrame(shapes, "id int, ring array<struct<x: double, y: double>>"))
    assert sorted(r.id for r in usable.collect()) == [1, 6]
    assert [r.id for r in L.meeting_box(L.boxed(usable), 2.0, -1.0, 5.0, 5.0).collect()] == [1]
    place = spark.createDataFrame([("c15m250x", 99.0), ("c15", 11.9), ("c15", 12.0)], "area string, km double")
    assert [r[0] for r in place.select(L.scope(F.col("area"), F.col("km"), "c15m250")).collect()] == ["municipal", "metropolitan", "periurban"]


def test_building_parts_with_holes_and_odd_numbers(spark, tmp_path):
    ring = lambda text: f"<gml:LinearRing><gml:posList srsDimension='2'>{text}</gml:posList></gml:LinearRing>"
    part = lambda i, floors, outer, inner="": (
        f"<m><bu:BuildingPart gml:id='{i}'><bu:geometry><gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior>{ring(outer)}</gml:exterior>{inner}</gml:PolygonPatch></gml:patches></gml:Surface></bu:geometry>"
        f"<bu:numberOfFloorsAboveGround>{floors}</bu:numberOfFloorsAboveGround></bu:BuildingPart></m>"
    )
    hole = f"<gml:interior>{ring('1 1 2 1 2 2')}</gml:interior>"
    (tmp_path / "a.gml").write_text("<c xmlns:bu='u' xmlns:gml='g'>" + part("p1", 3, " 0 0 4 0\n4 4 0 4 ", hole) + part("p2", 1, "0 0 1 0 x 1") + "</c>")
    got = {(r.polygon, r.floors, tuple((p.x, p.y) for p in r.ring)) for r in readers.building_parts(spark, str(tmp_path)).collect()}
    assert got == {("p1", 3, ((0, 0), (4, 0), (4, 4), (0, 4))), ("p1", 3, ((1, 1), (2, 1), (2, 2))), ("p2", 1, ((0, 0), (1, 0), (None, 1)))}


def test_scenarios_that_do_not_line_up(spark, tmp_path):
    rows = [("m", "local", 0.0, c, 1.0) for c in "abc"] + [("m", "local", 1.0, c, 1.0) for c in "abb"] + [("n", "local", 0.0, "z", 1.0)]
    spark.createDataFrame(rows, "mode string, field string, delta double, cusec string, score double").write.parquet(str(tmp_path / "s"))
    _, lined = readers.scenario_scores(spark, str(tmp_path / "s"))
    assert {(r.mode, r.delta): (r.repeated, r.missing, r.aligned) for r in lined.collect()} == {("m", 0.0): (0, 0, True), ("m", 1.0): (1, 1, False), ("n", 0.0): (0, 0, True)}
