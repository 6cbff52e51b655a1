"""Registered queries: operators applied to the given tables, with the SQL that must agree."""

from umbra.plans import (  # noqa: F401
    decision_plans,
    field_plans,
    layer_plans,
    network_plans,
    panel_plans,
    policy_plans,
    quality_plans,
    regret_plans,
    shade_plans,
    shelter_plans,
    source_plans,
    spatial_plans,
)
from umbra.plans.inputs import REGISTRY

__all__ = ["REGISTRY"]
