"""Every query of the engine by name, and its SQL counterpart."""

from __future__ import annotations

from trailmark.plans import (  # noqa: F401  they register their queries
    analyze_queries,
    detection_queries,
    evaluation_queries,
    flow_queries,
    kit_queries,
    link_queries,
    rule_queries,
    source_queries,
    stream_queries,
)
from trailmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
