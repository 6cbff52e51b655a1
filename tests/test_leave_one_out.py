"""Leaving stations out in turn: few of them are compared with all others, and none is missed."""

from __future__ import annotations

import random
from collections import defaultdict
from statistics import median

import pytest

from umbra.operators import panel as P


def _quantile(values, p):
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def _plain(rows, stations, least):
    out = {}
    for gone in stations:
        instants, sums = defaultdict(list), defaultdict(list)
        for station, date, hour, t in rows:
            if station != gone:
                instants[date, hour].append((t, station))
        spreads = []
        for values in instants.values():
            if len(values) >= least:
                ts = sorted(t for t, _ in values)
                spreads.append(_quantile(ts, 0.9) - _quantile(ts, 0.1))
                for t, station in values:
                    sums[station].append(t - median(ts))
        means = {s: sum(x) / len(x) for s, x in sums.items()}
        if means:
            ends = min(means, key=lambda s: (round(-means[s], 9), s)), min(means, key=lambda s: (round(means[s], 9), s))
            out[gone] = (pytest.approx(sum(spreads) / len(spreads)), len(spreads), *ends)
    return out


@pytest.mark.parametrize(("stations", "instants", "each"), [(60, 120, 40), (6, 9, 3), (12, 200, 3), (3, 5, 4)])
def test_contenders_miss_no_end(spark, monkeypatch, stations, instants, each):
    random.seed(stations)
    rows = [(s, f"2024-07-{1 + i // 24:02d}", i % 24, float(random.randint(10, 40))) for s in range(stations) for i in random.sample(range(instants), min(each, instants))]
    panel = spark.createDataFrame(rows, "station long, date string, hour int, t double")
    places = spark.createDataFrame([(s,) for s in range(stations + 1)], "station long")
    seen, whole = [], P.contenders
    monkeypatch.setattr(P, "contenders", lambda totals: seen.append((whole(totals).count(), totals.count())) or whole(totals))
    got = {r.without: (r.dispersion, r.instants, r.hottest, r.coldest) for r in P.leave_one_out(panel, places, 2).collect()}
    assert got == _plain(rows, range(stations + 1), 2)
    if stations == 60:
        assert seen[0][0] <= seen[0][1] / 2
