"""Pairs in reach are found for places; sections and sites are unfolded last."""

from __future__ import annotations

from umbra.plans import shelter_plans as S
from umbra.plans.inputs import REGISTRY, sections

SMALL = "/root/testdata/sf0.001"


def test_sections_and_sites_are_not_shuffled_for_each_cell(spark):
    frame = REGISTRY.queries["she_reach"](spark, SMALL)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(cusec") < plan.index("Generate explode(site") < plan.index("Join Inner") < plan.index("collect_list(cusec")
    homes = [(r.cusec, r.x, r.y) for r in sections(spark, SMALL).where("reachable").collect()]
    spots = [(r.site, r.x, r.y) for r in S.sites(spark, SMALL).collect()]
    want = {(c, s) for c, x, y in homes for s, a, b in spots if (x - a) ** 2 + (y - b) ** 2 <= 3500.0**2}
    got = [(r.cusec, r.site) for r in frame.collect()]
    assert set(got) == want and len(got) == len(want)
