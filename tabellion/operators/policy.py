"""Governance policies over a table of change proposals.

A proposal row carries its payload as typed columns; a missing value means "not given". Every
policy is a Column expression, so a whole table of proposals is judged in one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.columns import present
from tabellion.operators.reconcile import leaked_values


@dataclass(frozen=True)
class Policy:
    policy_id: str
    name: str
    severity: str
    action: str
    limit: float | None = None


# fixed values: the declared policies
POLICIES = (
    Policy("POL-001", "no_sample_values_in_descriptions", "CRITICAL", "BLOCK_AND_REDACT"),
    Policy("POL-002", "pii_requires_steward_approval", "HIGH", "REQUIRE_APPROVAL"),
    Policy("POL-003", "agent_confidence_threshold", "MEDIUM", "REQUIRE_APPROVAL", 0.80),
    Policy("POL-004", "certification_quality_gate", "HIGH", "BLOCK", 0.85),
    Policy("POL-005", "certification_owner_mandatory", "HIGH", "BLOCK"),
    Policy("POL-006", "restricted_pii_no_public_access", "CRITICAL", "BLOCK"),
    Policy("POL-007", "tag_propagation_mandatory", "HIGH", "PROPAGATE"),
    Policy("POL-008", "pii_reason_chain_required", "HIGH", "AUDIT"),
    Policy("POL-009", "prohibit_empty_descriptions", "MEDIUM", "BLOCK"),
    Policy("POL-010", "enforce_valid_pii_types", "HIGH", "BLOCK"),
    Policy("POL-011", "high_null_rate_certification_block", "HIGH", "BLOCK", 95.0),
    Policy("POL-012", "glossary_mapping_confidence", "LOW", "REQUIRE_APPROVAL", 0.85),
    Policy("POL-013", "immutable_audit_logging", "CRITICAL", "LOG"),
    Policy("POL-014", "quality_rule_coverage_for_marts", "MEDIUM", "BLOCK"),
    Policy("POL-015", "disagreement_safety_quarantine", "HIGH", "QUARANTINE"),
)
BY_ID = {p.policy_id: p for p in POLICIES}

# fixed values: the approved PII types, and the shortest sample that counts as leaked
PII_TYPES = (
    "CUSTOMER_ID",
    "PERSON_NAME",
    "EMAIL",
    "PHONE_NUMBER",
    "PHYSICAL_ADDRESS",
    "POSTAL_CODE",
    "FINANCIAL",
    "CONFIDENTIAL_NOTES",
    "NONE",
)
SHORTEST_LEAK = 4
VIOLATION = "struct<policy_id: string, policy_name: string, severity: string, message: string, blocked: boolean>"

# payload columns of a proposal and the values that stand in for missing ones
PAYLOAD_DEFAULTS: dict[str, tuple[str, object]] = {
    "is_pii": ("boolean", False),
    "pii_type": ("string", "NONE"),
    "sensitivity_level": ("string", "INTERNAL"),
    "confidence": ("double", 1.0),
    "certification_status": ("string", "DRAFT"),
    "quality_score": ("double", 1.0),
    "null_percentage": ("double", 0.0),
    "quality_rules_count": ("bigint", 1),
    "is_mart": ("boolean", False),
}
PAYLOAD_OPTIONAL = {"description": "string", "sample_values": "array<string>", "owner": "string"}


def evaluate(
    proposals: DataFrame,
    policies: Sequence[Policy] = POLICIES,
    pii_types: Sequence[str] = PII_TYPES,
    shortest_leak: int = SHORTEST_LEAK,
) -> DataFrame:
    """Adds the verdict: violations, approval reasons, passed, requires_approval, can_write.

    Limits, names and severities come from ``policies``; a policy that is not listed is off.
    ``pii_types`` is the approved taxonomy.
    """
    by_id = {p.policy_id: p for p in policies}
    missing = {
        **{c: F.lit(None).cast(kind) for c, (kind, _) in PAYLOAD_DEFAULTS.items() if c not in proposals.columns},
        **{c: F.lit(None).cast(kind) for c, kind in PAYLOAD_OPTIONAL.items() if c not in proposals.columns},
    }
    complete = proposals.withColumns(missing) if missing else proposals
    judged = complete.withColumns(
        {"violations": _violations(by_id, pii_types, shortest_leak), "approval_reasons": _approval_reasons(by_id)}
    )
    passed = F.size("violations") == 0
    approval = F.size("approval_reasons") > 0
    return judged.drop(*missing).withColumns(
        {
            "passed": passed,
            "requires_approval": approval,
            "can_write": passed & ~approval,
            "policies_checked_count": F.lit(len(by_id)),
        }
    )


def violation_counts(verdicts: DataFrame) -> DataFrame:
    """How many proposals break each policy, and how often."""
    broken = verdicts.select("proposal_id", F.explode("violations").alias("v"))
    return broken.groupBy("v.policy_id", "v.severity").agg(
        F.count(F.lit(1)).alias("violations"), F.countDistinct("proposal_id").alias("proposals")
    )


def tag_coverage(expected: DataFrame, tags: DataFrame) -> DataFrame:
    """Propagated tags that are missing from the tag table, or stored without a reason chain.

    Both frames need asset_id and tag_name; ``tags`` also reason_chain (array).
    """
    wanted = expected.groupBy("asset_id", "tag_name").agg(F.count(F.lit(1)).alias("paths"))
    kept = tags.groupBy("asset_id", "tag_name").agg(F.max(F.size("reason_chain")).alias("longest"))
    judged = wanted.join(kept, ["asset_id", "tag_name"], "left")
    broken = F.when(F.col("longest").isNull(), "POL-007").when(F.col("longest") < 2, "POL-008")
    return judged.withColumn("policy_id", broken).filter(F.col("policy_id").isNotNull()).select(
        "policy_id", "asset_id", "tag_name", "paths"
    )


def glossary_review(mappings: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Glossary mappings below the confidence that lets them in unseen; none if the policy is off."""
    limit = next((p.limit for p in policies if p.policy_id == "POL-012"), None)
    return mappings.filter(F.col("confidence") < F.lit(limit)).withColumn("policy_id", F.lit("POL-012"))


def audit_coverage(decisions: DataFrame, audit: DataFrame) -> DataFrame:
    """Decisions (proposal_id, asset_id, action) without a record in the audit trail."""
    logged = audit.select("proposal_id", "action").distinct()
    return decisions.join(logged, ["proposal_id", "action"], "left_anti").withColumn("policy_id", F.lit("POL-013"))


def quarantine(reconciled: DataFrame) -> DataFrame:
    """Columns whose annotations disagree and must wait in quarantine."""
    disagree = F.exists("flags", lambda f: f["flag_type"] == "PATTERN_DISAGREEMENT")
    return reconciled.filter(disagree).select(
        "table_name", "column_name", "pii_type", F.lit("POL-015").alias("policy_id"), F.lit("QUARANTINED").alias("state")
    )


def _given(name: str) -> Column:
    kind, default = PAYLOAD_DEFAULTS[name]
    return F.coalesce(F.col(name).cast(kind), F.lit(default))


def _violations(by_id: Mapping[str, Policy], pii_types: Sequence[str], shortest_leak: int) -> Column:
    description, owner = F.col("description"), F.col("owner")
    certified = _given("certification_status") == "CERTIFIED"
    pii = _given("is_pii")
    no_samples = F.array().cast("array<string>")
    leaks = leaked_values(F.coalesce("sample_values", no_samples), F.coalesce(description, F.lit("")), shortest_leak)
    quality, nulls = _given("quality_score"), _given("null_percentage")
    gate, most = (by_id[i].limit if i in by_id else None for i in ("POL-004", "POL-011"))

    def broken(policy_id: str, condition: Column, message: Column) -> Column:
        if policy_id not in by_id:
            return F.lit(None).cast(VIOLATION)
        return F.when(condition, _violation(by_id[policy_id], message))

    single = present(
        broken("POL-004", certified & (quality < F.lit(gate)), F.concat(F.lit(f"Quality score must be at least {gate}, is "), quality.cast("string"), F.lit("."))),
        broken("POL-005", certified & (F.trim(F.coalesce(owner, F.lit(""))) == ""), F.lit("A certified asset needs an owner.")),
        broken("POL-006", pii & (_given("sensitivity_level") == "PUBLIC"), F.lit("PII cannot be public.")),
        broken("POL-009", F.coalesce(F.length(F.trim(description)) == 0, F.lit(False)), F.lit("A description cannot be blank.")),
        broken("POL-010", pii & ~_given("pii_type").isin(*pii_types), F.concat(F.lit("Unknown PII type "), _given("pii_type"), F.lit("."))),
        broken("POL-011", certified & (nulls > F.lit(most)), F.concat(F.lit(f"Null rate may not exceed {most}%, is "), nulls.cast("string"), F.lit("%."))),
        broken("POL-014", _given("is_mart") & (_given("quality_rules_count") <= 0), F.lit("A mart needs a quality rule.")),
    )
    if "POL-001" not in by_id:
        return single
    leaked = F.transform(
        leaks, lambda s: _violation(by_id["POL-001"], F.concat(F.lit("Description shows the sample value '"), s, F.lit("'.")))
    )
    return F.concat(leaked, single)


def _approval_reasons(by_id: Mapping[str, Policy]) -> Column:
    confidence = _given("confidence")
    reasons = [F.lit(None).cast("string")]
    if "POL-002" in by_id:
        reasons.append(F.when(_given("is_pii"), F.lit("POL-002: PII needs a steward's approval.")))
    if "POL-003" in by_id:
        threshold = by_id["POL-003"].limit
        told = F.concat(F.lit("POL-003: confidence "), F.format_number(confidence, 2), F.lit(f" is below {threshold}."))
        reasons.append(F.when(confidence < threshold, told))
    return present(*reasons)


def _violation(policy: Policy, message: Column) -> Column:
    return F.struct(
        F.lit(policy.policy_id).alias("policy_id"),
        F.lit(policy.name).alias("policy_name"),
        F.lit(policy.severity).alias("severity"),
        message.alias("message"),
        F.lit(True).alias("blocked"),
    )
