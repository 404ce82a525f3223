"""Registered queries against their SQL oracles, on the smallest test tables.

The default run takes a cross-section; ``TABELLION_ALL_QUERIES=1`` takes every query.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import DATA, compare, connect

FOLDER = f"{DATA}/sf0.001"
SAMPLE = [
    "fct_orders", "customer_ltv", "unified_events", "federated_shipments", "q06", "q12", "q33", "profile_orders", "classify_pii",
    "propose_rules", "rule_unique", "rule_referential_integrity", "table_quality", "policy_eval", "proposal_review", "audit_chain",
    "asset_history", "asset_list", "asset_search_batch", "lineage_closure", "certified_pii_dashboards", "pii_eval", "result_diff",
    "usage_rollup", "request_load_1d", "src_csv_roundtrip", "catalog_sync_upsert",
]
QUERIES = entry.queries()
NAMES = list(QUERIES) if os.environ.get("TABELLION_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    outcome = compare(spark, duck, FOLDER, name, QUERIES[name], entry.oracle_sql().get(name))
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
