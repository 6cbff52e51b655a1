"""Replicates of units are made where the unit's days are."""

from __future__ import annotations

from umbra.operators import regret as R


def test_no_replicate_is_shuffled(spark):
    days = [(u, f"d{i}", float(i % 3), float(i), 1 + i % 2) for u in "abc" for i in range(6) if (u, i) != ("c", 0)]
    sums = spark.createDataFrame(days, "cusec string, date string, coarse double, local double, n long")
    drawn = [(b, f"d{(b * i) % 6}", 1 + i) for b in range(60) for i in range(2)]
    drawn = list({(b, d): (b, d, t) for b, d, t in drawn}.values())
    got = R.replicated_columns(sums, spark.createDataFrame(drawn, "b long, date string, times long"), ["cusec"], ["coarse", "local"])
    want = {}
    for u in "abc":
        for b in range(60):
            rows = [(c * t, x * t, n * t) for o, d, c, x, n in days if o == u for e, f, t in drawn if (e, f) == (b, d)]
            if rows:
                top = [sum(z) for z in zip(*rows, strict=True)]
                want[u, b] = (top[0] / top[2], top[1] / top[2])
    assert {(r.cusec, r.b): (round(r.coarse, 9), round(r.local, 9)) for r in got.collect()} == {k: (round(x, 9), round(y, 9)) for k, (x, y) in want.items()}
    # dealt by unit alone, and nothing is dealt again by unit and replicates
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(cusec" in line]
    assert len(dealt) == 1 and "pack" not in dealt[0], dealt
