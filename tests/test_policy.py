import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabellion.operators import approval, audit, policy

SCHEMA = (
    "proposal_id int, asset_id string, change_type string, proposed_by string, description string, sample_values array<string>, is_pii boolean, "
    "pii_type string, sensitivity_level string, confidence double, certification_status string, quality_score double, owner string, "
    "null_percentage double, quality_rules_count long, is_mart boolean, tag_name string, tag_value string"
)
NAMES = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]


def judge(spark, **payload):
    row = {"proposal_id": 1, "asset_id": "a", "change_type": "ADD_TAG", "proposed_by": "agent", **payload}
    df = spark.createDataFrame([tuple(row.get(n) for n in NAMES)], SCHEMA)
    return policy.evaluate(df).first()


CASES = [
    ("POL-001", {"description": "shows ABCD here", "sample_values": [" abcd "]}, {"description": "shows abc", "sample_values": ["abc"]}),
    ("POL-004", {"certification_status": "CERTIFIED", "quality_score": 0.84, "owner": "x"}, {"certification_status": "CERTIFIED", "quality_score": 0.85, "owner": "x"}),
    ("POL-005", {"certification_status": "CERTIFIED", "owner": "  "}, {"certification_status": "CERTIFIED", "owner": "x"}),
    ("POL-006", {"is_pii": True, "sensitivity_level": "PUBLIC", "pii_type": "EMAIL"}, {"is_pii": True, "pii_type": "EMAIL"}),
    ("POL-009", {"description": "  "}, {}),
    ("POL-010", {"is_pii": True, "pii_type": "SHOE"}, {"is_pii": True, "pii_type": "NONE"}),
    ("POL-011", {"certification_status": "CERTIFIED", "owner": "x", "null_percentage": 95.5}, {"certification_status": "CERTIFIED", "owner": "x", "null_percentage": 95.0}),
    ("POL-014", {"is_mart": True, "quality_rules_count": 0}, {"is_mart": True}),
]


@pytest.mark.parametrize("policy_id,bad,good", CASES)
def test_blocking_policies(spark, policy_id, bad, good):
    assert [v.policy_id for v in judge(spark, **bad).violations] == [policy_id]
    assert judge(spark, **good).violations == []


def test_approvals_and_defaults(spark):
    assert judge(spark, is_pii=True, pii_type="EMAIL").requires_approval
    assert judge(spark, confidence=0.79).requires_approval and not judge(spark, confidence=0.80).requires_approval
    empty = judge(spark)
    assert empty.can_write and empty.passed and empty.policies_checked_count == 15


def test_every_leaked_sample_is_a_violation(spark):
    found = judge(spark, description="alpha beta", sample_values=["alpha", "beta", "gamma"])
    assert [v.policy_id for v in found.violations] == ["POL-001", "POL-001"]


def test_queue_lifecycle(spark):
    rows = [
        {"proposal_id": 1, "confidence": 0.95, "change_type": "UPDATE_DESCRIPTION", "description": "fine"},
        {"proposal_id": 2, "is_pii": True, "pii_type": "EMAIL", "change_type": "ADD_TAG"},
        {"proposal_id": 3, "is_pii": True, "pii_type": "EMAIL", "sensitivity_level": "PUBLIC", "change_type": "ADD_TAG"},
        {"proposal_id": 4, "confidence": 0.5, "change_type": "CHANGE_CERTIFICATION"},
    ]
    filled = [tuple({"asset_id": f"a{r['proposal_id']}", "proposed_by": "agent", **r}.get(n) for n in NAMES) for r in rows]
    routed = approval.route(policy.evaluate(spark.createDataFrame(filled, SCHEMA)))
    assert {r.proposal_id: r.status for r in routed.collect()} == {1: "AUTO_APPROVED", 2: "PENDING", 3: "REJECTED", 4: "PENDING"}
    decisions = spark.createDataFrame(
        [(1, 2, "ann", "reject", "no", dt.datetime(2024, 1, 1)), (2, 2, "ann", "approve", "ok", dt.datetime(2024, 1, 2)), (3, 9, "ann", "approve", "?", dt.datetime(2024, 1, 2)), (4, 4, "bob", "later", "", dt.datetime(2024, 1, 2))],
        "decision_id int, proposal_id int, steward string, decision string, notes string, decided_at timestamp_ntz",
    )
    reviewed = approval.review(routed, decisions)
    assert {r.proposal_id: r.status for r in reviewed.collect()} == {1: "AUTO_APPROVED", 2: "APPROVED", 3: "REJECTED", 4: "REJECTED"}
    tag = approval.approved_tags(reviewed).collect()
    assert [(t.asset_id, t.tag_name, t.tag_value, t.reason) for t in tag] == [("a2", "PII", "EMAIL", "ok")]
    assert [c.description for c in approval.approved_changes(reviewed).collect()] == ["fine"]
    assert [d.decision_id for d in approval.unknown_decisions(routed, decisions).collect()] == [3]


def events(spark, n=90, assets=2):
    rows = [
        (f"a{i % assets}", i, dt.datetime(2024, 1, 1, 0, i // 60, i % 60), "ann", "EDIT", ["POL-002", "POL-001"], None if i < assets else {"s": str(i - 1), "gone": "x"}, {"s": str(i), "t": None})
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "asset_id string, event_id int, event_time timestamp_ntz, actor string, action string, policy_ids_evaluated array<string>, before_state map<string,string>, after_state map<string,string>",
    )


ORDER = ["event_time", "event_id"]


@pytest.mark.parametrize("limit", [10, 10_000])
def test_audit_chain_verifies_and_shows_tampering(spark, limit):
    trail = audit.append(events(spark), ORDER, segment_rows=10, max_group_rows=limit).cache()
    assert trail.count() == 90 and audit.verify(trail, 10).isEmpty()
    actor = trail.withColumn("actor", F.when((F.col("asset_id") == "a0") & (F.col("record_id") == 3), "eve").otherwise(F.col("actor")))
    assert [(r.asset_id, r.record_id, r.reason) for r in audit.verify(actor, 10).collect()] == [("a0", 3, "CONTENT")]
    state = trail.withColumn("after_state", F.when(F.col("event_id") == 8, F.create_map(F.lit("s"), F.lit("0"))).otherwise(F.col("after_state")))
    assert [r.reason for r in audit.verify(state, 10).collect()] == ["CONTENT"]
    cut = trail.filter("not (asset_id = 'a1' and record_id = 15)")
    assert [(r.record_id, r.reason) for r in audit.verify(cut, 10).collect()] == [(16, "MISSING_RECORD")]


def test_seal_shows_a_dropped_segment(spark):
    trail = audit.append(events(spark), ORDER, segment_rows=5).cache()
    sealed = audit.seal(trail, 5, fan=3).cache()
    assert audit.verify_seal(trail, sealed, 5, fan=3).isEmpty()
    cut = trail.filter("not (asset_id = 'a1' and record_id between 11 and 15)")
    assert [(r.asset_id, r.record_id, r.reason) for r in audit.verify(cut, 5).collect()] == [("a1", 16, "MISSING_RECORD")]
    assert [r.asset_id for r in audit.verify_seal(cut, sealed, 5, fan=3).collect()] == ["a1"]


def test_deletions_at_segment_ends_are_found(spark):
    trail = audit.append(events(spark), ORDER, segment_rows=5).cache()
    sealed = audit.seal(trail, 5).cache()
    sizes = {r.asset_id: r.chain_length for r in sealed.collect()}

    def found(condition):
        rows = audit.verify(trail.filter(f"not ({condition})"), 5, sealed).collect()
        return [(r.asset_id, r.record_id, r.reason) for r in rows]

    assert found("false") == []
    assert found("asset_id = 'a1' and record_id = 10") == [("a1", 11, "MISSING_RECORD")]
    assert found("asset_id = 'a1' and record_id = 1") == [("a1", 2, "MISSING_RECORD")]
    assert found(f"asset_id = 'a1' and record_id = {sizes['a1']}") == [("a1", sizes["a1"], "MISSING_TAIL")]
    assert found("asset_id = 'a0'") == [("a0", sizes["a0"], "MISSING_TAIL")]
    root = audit.estate_root(sealed).first()
    assert (root.assets, root.records) == (len(sizes), 90)
    assert audit.estate_root(sealed.filter("asset_id <> 'a0'")).first().estate_root != root.estate_root


def test_continued_chain_equals_one_chain(spark):
    whole = audit.append(events(spark), ORDER, segment_rows=10)
    first = audit.append(events(spark).filter("event_id < 33"), ORDER, segment_rows=10)
    second = audit.append(events(spark).filter("event_id >= 33"), ORDER, audit.heads(first), segment_rows=10)
    both = first.unionByName(second).select("event_id", "record_id", "prev_hash", "curr_hash")
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.select(both.columns).collect()))


def test_policies_are_data(spark):
    rows = spark.createDataFrame([(1, "CERTIFIED", 0.6, 0.85, "me", True, "SHOE_SIZE")], "proposal_id int, certification_status string, quality_score double, confidence double, owner string, is_pii boolean, pii_type string")

    def told(*args):
        row = policy.evaluate(rows, *args).first()
        return [v.policy_id for v in row.violations], [r[:7] for r in row.approval_reasons], row.policies_checked_count

    assert told() == (["POL-004", "POL-010"], ["POL-002"], 15)
    strict = [policy.Policy("POL-003", "c", "MEDIUM", "REQUIRE_APPROVAL", 0.9), policy.Policy("POL-004", "q", "LOW", "BLOCK", 0.5)]
    assert told(strict) == ([], ["POL-003"], 2)
    assert told(policy.POLICIES, ["SHOE_SIZE"]) == (["POL-004"], ["POL-002"], 15)
