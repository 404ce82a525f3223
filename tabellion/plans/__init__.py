"""Queries over the test tables, each paired with an independent SQL oracle."""

from tabellion.plans import (  # noqa: F401  (importing a module registers its queries)
    catalog_queries,
    enrich_queries,
    estate_queries,
    evaluate_queries,
    lineage_queries,
    policy_queries,
    profile_queries,
    quality_queries,
    question_queries,
    stream_queries,
)
from tabellion.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
