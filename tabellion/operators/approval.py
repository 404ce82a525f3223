"""Routing judged proposals, applying steward decisions, and turning approvals into changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import first_match, stable_id

# fixed values: proposal states and the reviewers that the engine itself stands for
AUTO_APPROVED, APPROVED, REJECTED, PENDING = "AUTO_APPROVED", "APPROVED", "REJECTED", "PENDING"
AUTO_REVIEWER, GATE_REVIEWER = "POLICY_ENGINE_AUTO", "POLICY_ENGINE_GATE"


def route(verdicts: DataFrame) -> DataFrame:
    """Status of each judged proposal: a violation rejects it even if it also needs approval."""
    status = first_match([(F.col("can_write"), AUTO_APPROVED), (~F.col("passed"), REJECTED)], PENDING)
    messages = F.array_join(F.transform("violations", lambda v: v["message"]), "; ")
    return verdicts.withColumns(
        {
            "status": status,
            "reviewed_by": first_match([(F.col("can_write"), AUTO_REVIEWER), (~F.col("passed"), GATE_REVIEWER)], None),
            "review_notes": first_match(
                [(F.col("can_write"), "All policies passed."), (~F.col("passed"), F.concat(F.lit("Blocked: "), messages))],
                None,
            ),
        }
    )


def from_enrichment(reconciled: DataFrame, proposed_by: str = "enrichment", database: str = "estate.public") -> DataFrame:
    """Change proposals for reconciled columns: a description each, and a tag where the column is PII.

    Closes the loop from enrichment to the catalog: the proposals go through ``policy.evaluate``,
    ``route`` and ``review`` like any others.
    """
    asset = F.concat_ws(".", F.lit(database), "table_name", "column_name")
    kinds = F.array_compact(F.array(F.lit("UPDATE_DESCRIPTION"), F.when(F.col("is_pii"), F.lit("ADD_TAG"))))
    listed = reconciled.withColumns({"asset_id": asset, "change_type": F.explode(kinds)})
    return listed.select(
        stable_id("asset_id", "change_type").alias("proposal_id"),
        "asset_id",
        "change_type",
        F.lit(proposed_by).alias("proposed_by"),
        "description",
        "is_pii",
        "pii_type",
        "sensitivity_level",
        F.col("overall_confidence").alias("confidence"),
        F.lit(None).cast("string").alias("certification_status"),
        F.lit(None).cast("string").alias("tag_name"),
        F.lit(None).cast("string").alias("tag_value"),
    )


def pending(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("status") == PENDING)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per proposal, reduced before it is joined."""
    last = F.max_by(F.struct("steward", "decision", "notes", "decided_at"), F.struct("decided_at", "decision_id"))
    return decisions.groupBy("proposal_id").agg(last.alias("d")).select("proposal_id", "d.*")


def review(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals after the stewards' decisions; only an APPROVE decision approves."""
    joined = routed.join(latest_decisions(decisions), "proposal_id", "left")
    decided = F.col("decision").isNotNull()
    outcome = F.when(F.upper("decision") == "APPROVE", APPROVED).otherwise(REJECTED)
    return joined.withColumns(
        {
            "status": F.when(decided, outcome).otherwise(F.col("status")),
            "reviewed_by": F.when(decided, F.col("steward")).otherwise(F.col("reviewed_by")),
            "review_notes": F.when(decided, F.col("notes")).otherwise(F.col("review_notes")),
            "reviewed_at": F.col("decided_at"),
        }
    ).drop("steward", "decision", "notes", "decided_at")


def unknown_decisions(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions about proposals that do not exist; the caller must treat them as errors."""
    return decisions.join(routed.select("proposal_id"), "proposal_id", "left_anti")


def approved_tags(reviewed: DataFrame) -> DataFrame:
    """Tag rows from approved ADD_TAG proposals."""
    tag_name = F.coalesce("tag_name", F.when(F.coalesce("is_pii", F.lit(False)), "PII").otherwise("TAG"))
    tag_value = F.coalesce(F.nullif("pii_type", F.lit("")), F.nullif("tag_value", F.lit("")), F.lit("TRUE"))
    approved = _approved(reviewed).filter(F.col("change_type") == "ADD_TAG")
    return approved.select(
        stable_id("proposal_id", "asset_id", tag_name).alias("tag_id"),
        "asset_id",
        tag_name.alias("tag_name"),
        tag_value.alias("tag_value"),
        F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence"),
        F.col("proposed_by").alias("source"),
        F.coalesce(F.nullif("review_notes", F.lit("")), F.concat(F.lit("Approved change from "), "proposed_by")).alias("reason"),
    )


def approved_changes(reviewed: DataFrame) -> DataFrame:
    """Catalog changes from approved description and certification proposals.

    Proposed rules and tags change nothing in the asset table.
    """
    kind = F.col("change_type")
    described = (kind == "UPDATE_DESCRIPTION") & (F.coalesce("description", F.lit("")) != "")
    certified = kind == "CHANGE_CERTIFICATION"
    return _approved(reviewed).filter(described | certified).select(
        "proposal_id",
        "asset_id",
        F.when(described, F.col("description")).alias("description"),
        F.when(certified, F.coalesce("certification_status", F.lit("CERTIFIED"))).alias("certification_status"),
        F.col("reviewed_by").alias("changed_by"),
        F.col("review_notes").alias("reason"),
    )


def decision_records(reviewed: DataFrame, as_of: str = "1970-01-01 00:00:00") -> DataFrame:
    """What each closed proposal must leave in the audit trail, ready for ``audit.append``.

    Proposals the engine closed itself carry the time of the run, ``as_of``.
    """
    run_time = F.lit(as_of).cast("timestamp_ntz")
    decided = F.coalesce("reviewed_at", run_time) if "reviewed_at" in reviewed.columns else run_time
    policies = F.transform("violations", lambda v: v["policy_id"])
    closed = reviewed.filter(F.col("status") != PENDING)
    return closed.select(
        "proposal_id",
        "asset_id",
        decided.alias("event_time"),
        F.col("reviewed_by").alias("actor"),
        F.concat(F.lit("PROPOSAL_"), "status").alias("action"),
        policies.alias("policy_ids_evaluated"),
        F.create_map(F.lit("status"), F.lit(PENDING)).alias("before_state"),
        F.create_map(F.lit("status"), F.col("status"), F.lit("notes"), F.coalesce("review_notes", F.lit(""))).alias("after_state"),
    )


def _approved(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("status").isin(APPROVED, AUTO_APPROVED))
