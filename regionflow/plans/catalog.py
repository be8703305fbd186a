"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from regionflow.plans.registry import REGISTRY, Query

MODULES = ["series_queries", "network_queries", "scoring_queries", "sampling_queries", "source_queries", "stream_queries", "store_queries"]


def catalog() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"regionflow.plans.{module}")
    return dict(REGISTRY)
