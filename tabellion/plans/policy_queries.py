"""Policies, routing, reviews and the audit trail, over proposals and events derived from the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import joined
from tabellion.functions.ordered import OrderedGroups
from tabellion.operators import approval, audit, classify, policy, proofs, reconcile
from tabellion.operators.profile import profile_table
from tabellion.plans.binding import Estate
from tabellion.plans.enrich_queries import RULES, leaky
from tabellion.plans.oracle import define, with_tables
from tabellion.plans.profile_queries import pattern_hits
from tabellion.plans.registry import query
from tabellion.plans.schemas import SCHEMAS
from tabellion.session import checkpointed


def proposals(e: Estate) -> DataFrame:
    """One proposal per part, its payload derived from the part's columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*[F.lit(k) for k in ("ADD_TAG", "UPDATE_DESCRIPTION", "CHANGE_CERTIFICATION", "PROPOSE_RULE")])
    return e.table("part").select(
        key.alias("proposal_id"),
        F.concat(F.lit("asset."), (key % 500).cast("string")).alias("asset_id"),
        F.element_at(kinds, (key % 4).cast("int") + 1).alias("change_type"),
        F.concat(F.lit("agent:"), "p_brand").alias("proposed_by"),
        F.when(key % 11 == 0, "   ").when(key % 13 != 0, F.concat(F.lit("Part "), F.upper("p_name"))).alias("description"),
        F.when(key % 17 == 0, F.array(F.concat(F.lit(" "), "p_name"), "p_type"))
        .when(key % 2 == 0, F.array(F.concat("p_brand", F.lit("x"))))
        .alias("sample_values"),
        F.when(key % 19 != 0, size < 8).alias("is_pii"),
        F.when(F.col("p_type") == "PROMO", "EMAIL").when(F.col("p_type") == "ECONOMY", "SHOE_SIZE").alias("pii_type"),
        F.when(size % 5 == 0, "PUBLIC").when(size % 7 != 0, "INTERNAL").alias("sensitivity_level"),
        ((size + 55).cast("double") / 100).alias("confidence"),
        F.when(key % 9 == 0, "CERTIFIED").alias("certification_status"),
        ((key % 100).cast("double") / 100).alias("quality_score"),
        F.when(key % 23 == 0, " ").when(key % 29 != 0, F.col("p_brand")).alias("owner"),
        (key % 100).cast("double").alias("null_percentage"),
        (key % 4).alias("quality_rules_count"),
        (key % 5 == 0).alias("is_mart"),
        F.when(key % 8 == 0, "TOPIC").alias("tag_name"),
        F.when(key % 16 == 0, F.col("p_type")).alias("tag_value"),
    )


define(
    "proposals_t",
    """SELECT p_partkey AS proposal_id, 'asset.' || (p_partkey % 500) AS asset_id,
    CASE p_partkey % 4 WHEN 0 THEN 'ADD_TAG' WHEN 1 THEN 'UPDATE_DESCRIPTION' WHEN 2 THEN 'CHANGE_CERTIFICATION' ELSE 'PROPOSE_RULE' END AS change_type,
    'agent:' || p_brand AS proposed_by,
    CASE WHEN p_partkey % 11 = 0 THEN '   ' WHEN p_partkey % 13 <> 0 THEN 'Part ' || upper(p_name) END AS description,
    CASE WHEN p_partkey % 17 = 0 THEN [' ' || p_name, p_type] WHEN p_partkey % 2 = 0 THEN [p_brand || 'x'] ELSE CAST([] AS VARCHAR[]) END AS sample_values,
    COALESCE(CASE WHEN p_partkey % 19 <> 0 THEN p_size < 8 END, FALSE) AS is_pii,
    CASE p_type WHEN 'PROMO' THEN 'EMAIL' WHEN 'ECONOMY' THEN 'SHOE_SIZE' END AS pii_type,
    CASE WHEN p_size % 5 = 0 THEN 'PUBLIC' ELSE 'INTERNAL' END AS sensitivity_level,
    CAST(p_size + 55 AS DOUBLE) / 100 AS confidence,
    CASE WHEN p_partkey % 9 = 0 THEN 'CERTIFIED' END AS certification_status,
    CAST(p_partkey % 100 AS DOUBLE) / 100 AS quality_score,
    CASE WHEN p_partkey % 23 = 0 THEN ' ' WHEN p_partkey % 29 <> 0 THEN p_brand END AS owner,
    CAST(p_partkey % 100 AS DOUBLE) AS null_percentage, p_partkey % 4 AS quality_rules_count, p_partkey % 5 = 0 AS is_mart,
    CASE WHEN p_partkey % 8 = 0 THEN 'TOPIC' END AS tag_name, CASE WHEN p_partkey % 16 = 0 THEN p_type END AS tag_value FROM part""",
)


def _v(policy_id: str, condition: str, message: str) -> str:
    severity = policy.BY_ID[policy_id].severity
    return f"CASE WHEN {condition} THEN {{'id': '{policy_id}', 'severity': '{severity}', 'message': {message}}} END"


def judged_sql(gate: str = "0.85", most: str = "95.0", threshold: str = "0.8", bad_types: str = "pii_type = 'SHOE_SIZE'", off: tuple[str, ...] = ()) -> str:
    """Verdicts under the given limits; ``off`` policies never fire."""

    def when(policy_id: str, condition: str) -> str:
        return "FALSE" if policy_id in off else condition

    return f"""SELECT *, len(violations) = 0 AS passed, len(reasons) > 0 AS requires_approval, len(violations) = 0 AND len(reasons) = 0 AS can_write
    FROM (SELECT *, list_transform(list_filter(list_transform(sample_values, lambda s: trim(s)), lambda s: length(s) >= 4 AND contains(lower(COALESCE(description, '')), lower(s))),
        lambda s: {{'id': 'POL-001', 'severity': 'CRITICAL', 'message': 'Description shows the sample value ''' || s || '''.'}})
      || list_filter([
        {_v('POL-004', f"certification_status = 'CERTIFIED' AND quality_score < {gate}::DOUBLE", f"'Quality score must be at least {gate}, is ' || quality_score || '.'")},
        {_v('POL-005', "certification_status = 'CERTIFIED' AND COALESCE(trim(owner), '') = ''", "'A certified asset needs an owner.'")},
        {_v('POL-006', "is_pii AND sensitivity_level = 'PUBLIC'", "'PII cannot be public.'")},
        {_v('POL-009', "trim(description) = ''", "'A description cannot be blank.'")},
        {_v('POL-010', f"is_pii AND {bad_types}", "'Unknown PII type ' || pii_type || '.'")},
        {_v('POL-011', f"certification_status = 'CERTIFIED' AND null_percentage > {most}", f"'Null rate may not exceed {most}%, is ' || null_percentage || '%.'")},
        {_v('POL-014', when('POL-014', 'is_mart AND quality_rules_count = 0'), "'A mart needs a quality rule.'")}], lambda v: v IS NOT NULL) AS violations,
      list_filter([CASE WHEN is_pii THEN 'POL-002: PII needs a steward''s approval.' END,
        CASE WHEN confidence < {threshold}::DOUBLE THEN 'POL-003: confidence ' || format('{{:.2f}}', confidence) || ' is below {threshold}.' END], lambda r: r IS NOT NULL) AS reasons
      FROM proposals_t)"""


define("judged_t", judged_sql())


def verdicts(e: Estate) -> DataFrame:
    return policy.evaluate(proposals(e))


@query(
    "policy_eval",
    """SELECT proposal_id, passed, requires_approval, can_write, CAST(15 AS INTEGER) AS policies_checked_count,
    array_to_string(list_transform(violations, lambda v: v.id || ':' || v.severity || ':' || v.message), '|') AS violations, array_to_string(reasons, '|') AS approval_reasons FROM judged_t""",
)
def policy_eval(e: Estate) -> DataFrame:
    told = F.transform("violations", lambda v: F.concat_ws(":", v["policy_id"], v["severity"], v["message"]))
    return verdicts(e).select(
        "proposal_id",
        "passed",
        "requires_approval",
        "can_write",
        "policies_checked_count",
        joined(told).alias("violations"),
        joined(F.col("approval_reasons")).alias("approval_reasons"),
    )


CHANGED_POLICIES = [
    replace(p, limit={"POL-003": 0.9, "POL-004": 0.5, "POL-011": 20.0}.get(p.policy_id, p.limit)) for p in policy.POLICIES if p.policy_id != "POL-014"
]


@query(
    "policy_eval_changed",
    f"""SELECT proposal_id, passed, requires_approval, can_write, CAST(14 AS INTEGER) AS policies_checked_count,
    array_to_string(list_transform(violations, lambda v: v.id || ':' || v.severity || ':' || v.message), '|') AS violations, array_to_string(reasons, '|') AS approval_reasons
    FROM ({judged_sql("0.5", "20.0", "0.9", "pii_type NOT IN ('EMAIL', 'NONE')", ("POL-014",))})""",
)
def policy_eval_changed(e: Estate) -> DataFrame:
    """Verdicts under other limits, a smaller taxonomy and one policy less."""
    told = F.transform("violations", lambda v: F.concat_ws(":", v["policy_id"], v["severity"], v["message"]))
    judged = policy.evaluate(proposals(e), CHANGED_POLICIES, ("EMAIL", "NONE"))
    kept = ["proposal_id", "passed", "requires_approval", "can_write", "policies_checked_count"]
    return judged.select(*kept, joined(told).alias("violations"), joined(F.col("approval_reasons")).alias("approval_reasons"))


@query(
    "policy_violation_counts",
    """SELECT v.id AS policy_id, v.severity AS severity, COUNT(*) AS violations, COUNT(DISTINCT proposal_id) AS proposals
    FROM (SELECT proposal_id, unnest(violations) AS v FROM judged_t) GROUP BY ALL""",
)
def policy_violation_counts(e: Estate) -> DataFrame:
    return policy.violation_counts(verdicts(e))


define(
    "routed_t",
    """SELECT *, CASE WHEN can_write THEN 'AUTO_APPROVED' WHEN NOT passed THEN 'REJECTED' ELSE 'PENDING' END AS status,
    CASE WHEN can_write THEN 'POLICY_ENGINE_AUTO' WHEN NOT passed THEN 'POLICY_ENGINE_GATE' END AS reviewed_by,
    CASE WHEN can_write THEN 'All policies passed.' WHEN NOT passed THEN 'Blocked: ' || array_to_string(list_transform(violations, lambda v: v.message), '; ') END AS review_notes FROM judged_t""",
)
define(
    "decisions_t",
    """SELECT event_id AS decision_id, event_id // 2 AS proposal_id, 'steward_' || user_id AS steward,
    CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'approve' ELSE 'REJECT' END AS decision, event_type AS notes, ts AS decided_at
    FROM events""",
)
define(
    "reviewed_t",
    """SELECT r.* REPLACE (CASE WHEN d.proposal_id IS NULL THEN r.status WHEN d.decision = 'approve' THEN 'APPROVED' ELSE 'REJECTED' END AS status,
      COALESCE(d.steward, r.reviewed_by) AS reviewed_by, CASE WHEN d.proposal_id IS NULL THEN r.review_notes ELSE d.notes END AS review_notes), d.decided_at AS reviewed_at
    FROM routed_t r LEFT JOIN (SELECT * FROM decisions_t QUALIFY ROW_NUMBER() OVER (PARTITION BY proposal_id ORDER BY decided_at DESC, decision_id DESC) = 1) d ON r.proposal_id = d.proposal_id""",
)


def decisions(e: Estate) -> DataFrame:
    """Steward decisions derived from events; some name proposals that do not exist."""
    approves = F.col("event_type").isin("purchase", "click", "view")
    return e.table("events").select(
        F.col("event_id").alias("decision_id"),
        F.expr("event_id div 2").alias("proposal_id"),
        F.concat(F.lit("steward_"), F.col("user_id").cast("string")).alias("steward"),
        F.when(approves, "approve").otherwise("REJECT").alias("decision"),
        F.col("event_type").alias("notes"),
        F.col("ts").alias("decided_at"),
    )


def routed(e: Estate) -> DataFrame:
    return approval.route(verdicts(e))


def reviewed(e: Estate) -> DataFrame:
    return approval.review(routed(e), decisions(e))


STATUS_COLUMNS = ["proposal_id", "asset_id", "change_type", "status", "reviewed_by", "review_notes"]


@query("proposal_routing", f"SELECT {', '.join(STATUS_COLUMNS)} FROM routed_t")
def proposal_routing(e: Estate) -> DataFrame:
    return routed(e).select(*STATUS_COLUMNS)


@query("proposal_pending", "SELECT proposal_id, asset_id, change_type, array_to_string(reasons, '|') AS approval_reasons FROM routed_t WHERE status = 'PENDING'")
def proposal_pending(e: Estate) -> DataFrame:
    return approval.pending(routed(e)).select("proposal_id", "asset_id", "change_type", joined(F.col("approval_reasons")).alias("approval_reasons"))


@query("proposal_review", f"SELECT {', '.join(STATUS_COLUMNS)}, reviewed_at FROM reviewed_t")
def proposal_review(e: Estate) -> DataFrame:
    return reviewed(e).select(*STATUS_COLUMNS, "reviewed_at")


@query(
    "proposal_unknown_decisions",
    "SELECT decision_id, proposal_id, steward, decision FROM decisions_t WHERE proposal_id NOT IN (SELECT p_partkey FROM part)",
)
def proposal_unknown_decisions(e: Estate) -> DataFrame:
    unknown = approval.unknown_decisions(routed(e), decisions(e))
    return unknown.select("decision_id", "proposal_id", "steward", "decision")


@query(
    "proposal_apply_tags",
    """SELECT sha256(concat_ws('|', proposal_id, asset_id, tag)) AS tag_id, asset_id, tag AS tag_name,
    COALESCE(pii_type, tag_value, 'TRUE') AS tag_value, confidence, proposed_by AS source, review_notes AS reason
    FROM (SELECT *, COALESCE(tag_name, CASE WHEN is_pii THEN 'PII' ELSE 'TAG' END) AS tag FROM reviewed_t) WHERE change_type = 'ADD_TAG' AND status IN ('APPROVED', 'AUTO_APPROVED')""",
)
def proposal_apply_tags(e: Estate) -> DataFrame:
    return approval.approved_tags(reviewed(e))


@query(
    "proposal_apply_changes",
    """SELECT proposal_id, asset_id, CASE WHEN change_type = 'UPDATE_DESCRIPTION' THEN description END AS description,
    CASE WHEN change_type = 'CHANGE_CERTIFICATION' THEN COALESCE(certification_status, 'CERTIFIED') END AS certification_status,
    reviewed_by AS changed_by, review_notes AS reason FROM reviewed_t
    WHERE status IN ('APPROVED', 'AUTO_APPROVED') AND ((change_type = 'UPDATE_DESCRIPTION' AND COALESCE(description, '') <> '') OR change_type = 'CHANGE_CERTIFICATION')""",
)
def proposal_apply_changes(e: Estate) -> DataFrame:
    return approval.approved_changes(reviewed(e))


@query(
    "policy_audit_coverage",
    """SELECT proposal_id, asset_id, 'PROPOSAL_' || status AS action, 'POL-013' AS policy_id FROM reviewed_t WHERE status <> 'PENDING' AND proposal_id % 41 = 0""",
)
def policy_audit_coverage(e: Estate) -> DataFrame:
    """Every 41st decision was never logged."""
    made = approval.decision_records(reviewed(e))
    logged = made.filter(F.col("proposal_id") % 41 != 0)
    return policy.audit_coverage(made.select("proposal_id", "asset_id", "action"), logged)


@query(
    "enrich_proposals",
    """SELECT sha256(asset_id || '|' || change_type) AS proposal_id, asset_id, change_type, CASE WHEN is_pii AND pii_type = 'SENSITIVE' THEN 'REJECTED' WHEN is_pii OR overall_confidence < 0.8::DOUBLE THEN 'PENDING' ELSE 'AUTO_APPROVED' END AS status,
    CASE WHEN change_type = 'UPDATE_DESCRIPTION' THEN description END AS description, pii_type
    FROM (SELECT *, 'estate.public.' || table_name || '.' || column_name AS asset_id, unnest(CASE WHEN is_pii THEN ['UPDATE_DESCRIPTION', 'ADD_TAG'] ELSE ['UPDATE_DESCRIPTION'] END) AS change_type FROM reconciled_t)""",
)
def enrich_proposals(e: Estate) -> DataFrame:
    """The reconciled columns of the estate as routed proposals."""
    routed_columns = approval.route(policy.evaluate(approval.from_enrichment(reconcile.reconcile(leaky(e)))))
    shown = F.when(F.col("change_type") == "UPDATE_DESCRIPTION", F.col("description"))
    return routed_columns.select("proposal_id", "asset_id", "change_type", "status", shown.alias("description"), "pii_type")


@query(
    "proposal_audit_trail",
    """SELECT asset_id, COUNT(*) AS chain_length, TRUE AS is_valid, CAST(COUNT(*) FILTER (WHERE status = 'REJECTED') AS BIGINT) AS rejections FROM reviewed_t WHERE status <> 'PENDING' GROUP BY asset_id""",
)
def proposal_audit_trail(e: Estate) -> DataFrame:
    """Every closed proposal logged in its asset's chain; the chains verified."""
    logged = audit.append(approval.decision_records(reviewed(e), "2024-01-01 00:00:00"), ["event_time", "proposal_id"])
    records = checkpointed(logged)
    rejections = records.groupBy("asset_id").agg(F.count_if(F.col("action") == "PROPOSAL_REJECTED").alias("rejections"))
    trails = audit.summary(records, audit.verify(records)).select("asset_id", "chain_length", "is_valid")
    return trails.join(rejections, "asset_id")


@query(
    "policy_glossary_review",
    "SELECT proposal_id, asset_id, p_type AS term, confidence, 'POL-012' AS policy_id FROM proposals_t JOIN part ON p_partkey = proposal_id WHERE confidence < 0.85::DOUBLE",
)
def policy_glossary_review(e: Estate) -> DataFrame:
    terms = e.table("part").select(F.col("p_partkey").alias("proposal_id"), F.col("p_type").alias("term"))
    mappings = proposals(e).select("proposal_id", "asset_id", "confidence").join(terms, "proposal_id")
    return policy.glossary_review(mappings)


@query(
    "policy_quarantine",
    "SELECT table_name, column_name, CASE WHEN contains(detected_patterns, 'ZIP') THEN 'POSTAL_CODE' ELSE 'SENSITIVE' END AS pii_type, 'POL-015' AS policy_id, 'QUARANTINED' AS state FROM ("
    + "\nUNION ALL\n".join(pattern_hits("orders", c, k) for c, k in SCHEMAS["orders"] if c != "o_custkey")
    + ") WHERE regexp_matches(detected_patterns, 'EMAIL|PHONE|ZIP')",
)
def policy_quarantine(e: Estate) -> DataFrame:
    """Order columns whose values look like contact data although no rule says so."""
    profiles = profile_table(e.table("orders"), "orders", patterns_from="values")
    return policy.quarantine(reconcile.reconcile(classify.annotate(profiles, RULES)))


SEGMENT = 20


def state_changes(e: Estate) -> DataFrame:
    """Each event as a change of its user's state, with the state before it."""
    previous = OrderedGroups(e.table("events"), ["user_id"], ["ts", "event_id"]).previous(
        {"_kind": "event_type", "_value": "value"}
    )

    def state(kind: str, value: str):
        return F.create_map(F.lit("kind"), F.col(kind), F.lit("value"), F.col(value).cast("decimal(18,2)").cast("string"))

    second = F.concat(F.lit("POL-00"), (F.col("event_id") % 9 + 1).cast("string"))
    return previous.select(
        F.col("user_id").alias("asset_id"),
        "event_id",
        F.col("ts").alias("event_time"),
        F.concat(F.lit("agent_"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        F.upper("event_type").alias("action"),
        F.array(second, F.lit("POL-002")).alias("policy_ids_evaluated"),
        F.when(F.col("_kind").isNotNull(), state("_kind", "_value")).alias("before_state"),
        state("event_type", "value").alias("after_state"),
    )


define(
    "state_changes_t",
    """SELECT *, 'kind=' || event_type || ',value=' || v AS after_text, COALESCE('kind=' || kind0 || ',value=' || v0, '') AS before_text,
    CASE WHEN kind0 IS NULL THEN 'created' ELSE array_to_string(list_filter([CASE WHEN kind0 <> event_type THEN 'kind:' || kind0 || '>' || event_type END, CASE WHEN v0 <> v THEN 'value:' || v0 || '>' || v END], lambda x: x IS NOT NULL), ',') END AS diff_text,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS record_id
    FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v, LAG(event_type) OVER w AS kind0, CAST(CAST(LAG(value) OVER w AS DECIMAL(18,2)) AS VARCHAR) AS v0
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
define(
    "bodies_t",
    """SELECT user_id AS asset_id, event_id, record_id, concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'agent_' || (event_id % 7), CAST(user_id AS VARCHAR), upper(event_type),
    array_to_string(list_sort(['POL-00' || (event_id % 9 + 1), 'POL-002']), ','), diff_text, before_text, after_text) AS body FROM state_changes_t""",
)
CHAIN = f"""chain_t AS (
    SELECT asset_id, event_id, record_id, sha256('segment|' || asset_id || '|0') AS prev_hash, sha256('1|' || sha256('segment|' || asset_id || '|0') || '|' || body) AS curr_hash FROM bodies_t WHERE record_id = 1
    UNION ALL
    SELECT b.asset_id, b.event_id, b.record_id, CASE WHEN (b.record_id - 1) % {SEGMENT} = 0 THEN sha256('segment|' || b.asset_id || '|' || ((b.record_id - 1) // {SEGMENT})) ELSE c.curr_hash END,
      sha256(b.record_id || '|' || CASE WHEN (b.record_id - 1) % {SEGMENT} = 0 THEN sha256('segment|' || b.asset_id || '|' || ((b.record_id - 1) // {SEGMENT})) ELSE c.curr_hash END || '|' || b.body)
    FROM chain_t c JOIN bodies_t b ON b.asset_id = c.asset_id AND b.record_id = c.record_id + 1)"""


def chain_sql(select: str) -> str:
    """A query over ``chain_t``; the recursive table goes last in the WITH list."""
    prefix = with_tables("SELECT * FROM bodies_t", recursive=True).rsplit("\nSELECT", 1)[0]
    return f"{prefix},\n{CHAIN}\n{select}"


def trail(e: Estate) -> DataFrame:
    return audit.append(state_changes(e), ["event_time", "event_id"], segment_rows=SEGMENT)


def tampered(records: DataFrame) -> DataFrame:
    """The trail with some actors changed, some records dropped and some links cut."""
    actor = F.when(F.col("event_id") % 500 == 7, "nobody").otherwise(F.col("actor"))
    link = F.when(F.col("event_id") % 700 == 9, F.sha2("prev_hash", 256)).otherwise(F.col("prev_hash"))
    return records.filter(F.col("event_id") % 900 != 11).withColumns({"actor": actor, "prev_hash": link})


@query("audit_chain", chain_sql("SELECT asset_id, event_id, record_id, prev_hash, curr_hash FROM chain_t"))
def audit_chain(e: Estate) -> DataFrame:
    return trail(e).select("asset_id", "event_id", "record_id", "prev_hash", "curr_hash")


@query("audit_verify", "SELECT COUNT(*) AS records, COUNT(DISTINCT user_id) AS assets, CAST(0 AS BIGINT) AS broken, TRUE AS is_valid FROM events")
def audit_verify(e: Estate) -> DataFrame:
    records = checkpointed(trail(e))
    broken = audit.verify(records, SEGMENT)
    return (
        audit.summary(records, broken)
        .agg(
            F.sum("chain_length").alias("records"),
            F.count(F.lit(1)).alias("assets"),
            F.count_if(~F.col("is_valid")).alias("broken"),
            F.bool_and("is_valid").alias("is_valid"),
        )
    )


@query(
    "audit_verify_tampered",
    """SELECT user_id AS asset_id, record_id, CASE WHEN event_id % 500 = 7 OR event_id % 700 = 9 THEN 'CONTENT' ELSE 'MISSING_RECORD' END AS reason
    FROM (SELECT *, LAG(event_id) OVER (PARTITION BY user_id ORDER BY record_id) AS earlier FROM state_changes_t)
    WHERE event_id % 900 <> 11 AND (event_id % 500 = 7 OR event_id % 700 = 9 OR earlier % 900 = 11)
    UNION ALL SELECT user_id, MAX(record_id), 'MISSING_TAIL' FROM state_changes_t GROUP BY user_id HAVING max_by(event_id, record_id) % 900 = 11""",
)
def audit_verify_tampered(e: Estate) -> DataFrame:
    records = checkpointed(trail(e))  # hashed once, read by the seal and by every check
    return audit.verify(tampered(records), SEGMENT, audit.seal(records, SEGMENT)).select("asset_id", "record_id", "reason")


@query(
    "audit_verify_seal",
    f"""SELECT user_id AS asset_id, MAX(record_id) AS chain_length, MAX(record_id) FILTER (event_id % 40 <> 11) AS found_length
    FROM (SELECT *, MAX(record_id) OVER (PARTITION BY user_id) AS last FROM state_changes_t) GROUP BY user_id
    HAVING COUNT(*) FILTER (event_id % 40 = 11 AND (record_id % {SEGMENT} = 0 OR record_id = last)) > 0""",
)
def audit_verify_seal(e: Estate) -> DataFrame:
    """Assets whose segment heads no longer lead to the sealed root after every 40th record was dropped."""
    records = checkpointed(trail(e))
    return audit.verify_seal(records.filter("event_id % 40 <> 11"), audit.seal(records, SEGMENT), SEGMENT)


@query(
    "audit_summary",
    chain_sql("SELECT asset_id, COUNT(*) AS chain_length, min_by(curr_hash, record_id) AS first_hash, max_by(curr_hash, record_id) AS last_hash, TRUE AS is_valid FROM chain_t GROUP BY asset_id"),
)
def audit_summary(e: Estate) -> DataFrame:
    records = checkpointed(trail(e))
    return audit.summary(records, audit.verify(records, SEGMENT))


@query(
    "audit_tail",
    chain_sql("SELECT asset_id, event_id, record_id, curr_hash FROM chain_t JOIN events USING (event_id) ORDER BY ts DESC, asset_id DESC, record_id DESC LIMIT 30"),
)
def audit_tail(e: Estate) -> DataFrame:
    return audit.tail(trail(e)).select("asset_id", "event_id", "record_id", "curr_hash")


SEALED = f"""SELECT asset_id, CAST(SUM(n) AS BIGINT) AS chain_length,
        CASE WHEN COUNT(*) = 1 AND MAX(widest) = 0 THEN max(digest) ELSE sha256(string_agg(digest, '|' ORDER BY place)) END AS root_hash
        FROM (SELECT *, MAX(place) OVER () AS widest FROM (SELECT asset_id, (record_id - 1) // {SEGMENT} AS place, COUNT(*) AS n, max_by(curr_hash, record_id) AS digest FROM chain_t GROUP BY ALL)) GROUP BY asset_id"""


@query("audit_seal", chain_sql(SEALED))
def audit_seal(e: Estate) -> DataFrame:
    return audit.seal(trail(e), SEGMENT)


def _estate_root_sql(digits: int = 4) -> str:
    level = f"SELECT substr(sha256(asset_id::VARCHAR), 1, {digits}) AS place, sha256(asset_id || '|' || chain_length || '|' || root_hash) AS digest, 1 AS assets, chain_length AS records FROM ({SEALED})"
    for depth in range(digits, -1, -1):
        level = f"SELECT substr(place, 1, {depth}) AS place, sha256(string_agg(digest, '|' ORDER BY place, digest)) AS digest, SUM(assets) AS assets, SUM(records) AS records FROM ({level}) GROUP BY substr(place, 1, {depth})"
    return f"SELECT CAST(assets AS BIGINT) AS assets, CAST(records AS BIGINT) AS records, digest AS estate_root FROM ({level})"


@query("audit_estate_root", chain_sql(_estate_root_sql()))
def audit_estate_root(e: Estate) -> DataFrame:
    """One root over the heads of all assets."""
    return audit.estate_root(audit.seal(trail(e), SEGMENT))


GROWTH = 4


def grown(e: Estate) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all records, the later ones, tree nodes, earlier seals, later seals): of every trail the last half came later."""
    records = checkpointed(trail(e))
    half = records.groupBy("asset_id").agg(F.ceil(F.max("record_id") / 2).alias("_half"))
    split = records.join(half, "asset_id")
    first, later = (split.where(c).drop("_half") for c in ("record_id <= _half", "record_id > _half"))
    old = checkpointed(proofs.grow(first, None, SEGMENT, GROWTH))
    nodes = checkpointed(old.unionByName(proofs.grow(later, old, SEGMENT, GROWTH)))
    return records, later, nodes, proofs.sealed_roots(old), proofs.sealed_roots(nodes)


HALVED = "SELECT *, CEIL(MAX(record_id) OVER (PARTITION BY user_id) / 2) AS half, MAX(record_id) OVER (PARTITION BY user_id) AS last FROM state_changes_t"


@query(
    "audit_growth",
    "SELECT user_id AS asset_id, CAST(MAX(half) AS BIGINT) AS earlier_length, MAX(record_id) AS chain_length, TRUE AS is_valid FROM (" + HALVED + ") GROUP BY user_id",
)
def audit_growth(e: Estate) -> DataFrame:
    """Trails that were sealed at half their length, proved to have grown into the later seals."""
    _, later, nodes, before, after = grown(e)
    wrong = proofs.verify_growth(later, nodes, before, after, SEGMENT, GROWTH).select(F.col("asset_id").alias("_asset")).distinct()
    lengths = before.select("asset_id", F.col("chain_length").alias("earlier_length")).join(after.select("asset_id", "chain_length"), "asset_id")
    return lengths.join(wrong, F.col("asset_id") == F.col("_asset"), "left").select("asset_id", "earlier_length", "chain_length", F.col("_asset").isNull().alias("is_valid"))


@query(
    "audit_growth_tampered",
    f"""SELECT user_id AS asset_id, record_id, 'CONTENT' AS reason FROM ({HALVED}) WHERE record_id > half AND event_id % 500 = 7
    UNION ALL SELECT user_id, MIN(record_id), 'NEW_ROOT' FROM (SELECT DISTINCT user_id, CAST(last AS BIGINT) AS record_id FROM ({HALVED}) WHERE record_id > half AND record_id = last AND event_id % 300 = 5) GROUP BY user_id""",
)
def audit_growth_tampered(e: Estate) -> DataFrame:
    """Later records with some actors changed, and some last hashes replaced with all that depends on them."""
    _, later, nodes, before, after = grown(e)
    last = later.groupBy("asset_id").agg(F.max("record_id").alias("_last"))
    actor = F.when(F.col("event_id") % 500 == 7, "nobody").otherwise(F.col("actor"))
    replaced = (F.col("record_id") == F.col("_last")) & (F.col("event_id") % 300 == 5)
    changed = later.join(last, "asset_id").withColumns({"actor": actor, "_cut": replaced})
    # a replaced last record is consistent in itself: only the seal tells
    kind = F.when(F.col("_cut"), F.lit("FORGED")).otherwise(F.col("action"))
    forged = changed.withColumn("action", kind)
    digest = F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.col("prev_hash"), audit.record_body()), 256)
    forged = forged.withColumn("curr_hash", F.when(F.col("_cut") & (F.col("event_id") % 500 != 7), digest).otherwise(F.col("curr_hash")))
    return proofs.verify_growth(forged.drop("_cut", "_last"), nodes, before, after, SEGMENT, GROWTH)


@query(
    "audit_segments",
    f"""SELECT user_id AS asset_id, record_id, 'CONTENT' AS reason FROM state_changes_t WHERE ((record_id - 1) // {SEGMENT}) % 2 = 0 AND event_id % 500 = 7""",
)
def audit_segments(e: Estate) -> DataFrame:
    """Every other segment, with some actors changed, against the seals; the others are not read."""
    records, _, nodes, _, after = grown(e)
    every_other = records.where(F.floor((F.col("record_id") - 1) / SEGMENT) % 2 == 0)
    actor = F.when(F.col("event_id") % 500 == 7, "nobody").otherwise(F.col("actor"))
    return proofs.verify_segments(every_other.withColumn("actor", actor), nodes, after, SEGMENT, GROWTH)


@query("state_diff", "SELECT user_id AS asset_id, event_id, diff_text, before_text, after_text FROM state_changes_t")
def state_diff(e: Estate) -> DataFrame:
    before, after = F.col("before_state"), F.col("after_state")
    return state_changes(e).select(
        "asset_id",
        "event_id",
        audit.diff_text(before, after).alias("diff_text"),
        audit.state_text(before).alias("before_text"),
        audit.state_text(after).alias("after_text"),
    )
