"""Classification, description, glossary, rule proposal and reconciliation of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import joined
from tabellion.functions.patterns import TEXT_PATTERNS
from tabellion.operators import classify, reconcile, textscan
from tabellion.plans.binding import Estate
from tabellion.plans.oracle import define, half_up
from tabellion.plans.profile_queries import estate_profile
from tabellion.plans.registry import query

# fixed values: names of the test tables' own sensitive columns
TEST_KEYWORDS = {"CUSTOMER_ID": ("custkey", "userid"), "PERSON_NAME": ("cname", "sname"), "FINANCIAL": ("acctbal",)}
RULES = classify.with_keywords(TEST_KEYWORDS)
UPSTREAM = [("orders", "o_totalprice", "PII_FINANCIAL"), ("events", "value", "PII"), ("events", "user_id", "PII"), ("part", "p_size", "INTERNAL")]


def annotated(e: Estate) -> DataFrame:
    return classify.annotate(estate_profile(e), RULES)


def _name_has(words: tuple[str, ...], name: str = "plain") -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


def _chain(branches: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


PII_HITS = [
    ("list_contains(detected_patterns, 'EMAIL_PATTERN') OR contains(plain, 'email')", "EMAIL", "RESTRICTED", 0.98, "GDPR,LGPD"),
    (
        "regexp_matches(plain, 'phone|fax|tel') OR (list_contains(detected_patterns, 'PHONE_PATTERN') AND NOT regexp_matches(plain, 'id|count|num'))",
        "PHONE_NUMBER",
        "RESTRICTED",
        0.96,
        "GDPR,LGPD",
    ),
    ("regexp_matches(plain, 'zip|postal|cep')", "POSTAL_CODE", "CONFIDENTIAL", 0.95, "GDPR,LGPD"),
    ("regexp_matches(plain, 'customerid|customeruniqueid|custkey|userid')", "CUSTOMER_ID", "RESTRICTED", 0.97, "GDPR,LGPD"),
    ("regexp_matches(plain, 'contactname|firstname|lastname|shipname|cname|sname')", "PERSON_NAME", "RESTRICTED", 0.96, "GDPR,LGPD"),
    ("regexp_matches(plain, 'address|street')", "PHYSICAL_ADDRESS", "RESTRICTED", 0.96, "GDPR,LGPD"),
    ("regexp_matches(plain, 'birthdate|dob')", "CONFIDENTIAL_NOTES", "CONFIDENTIAL", 0.95, "GDPR,LGPD"),
    ("regexp_matches(plain, 'paymentvalue|paymentamount|creditcard|paymenttype|acctbal')", "FINANCIAL", "RESTRICTED", 0.94, "PCI-DSS"),
    ("regexp_matches(plain, 'notes|comment|reviewcomment')", "CONFIDENTIAL_NOTES", "CONFIDENTIAL", 0.91, "GDPR,LGPD"),
]


def _pii(position: int, otherwise: str, text: bool = True) -> str:
    return _chain([(hit[0], f"'{hit[position]}'" if text else f"{hit[position]}::DOUBLE") for hit in PII_HITS], otherwise)


define(
    "named_profile",
    """SELECT *, lower(regexp_replace(column_name, '[^a-zA-Z0-9]', '', 'g')) AS plain, lower(column_name) AS low FROM estate_profile""",
)
define(
    "pii_verdict",
    f"""SELECT *, pii_type <> 'NONE' AS is_pii,
    list_filter([CASE WHEN pii_type <> 'NONE' THEN 'Name or values indicate ' || pii_type || '.' ELSE 'Name and values show no personal trait.' END,
      'Null rate ' || null_percentage || '%, unique ' || is_unique || '.'], lambda x: x IS NOT NULL) AS clf_evidence
    FROM (SELECT *, {_pii(1, "'NONE'")} AS pii_type, {_pii(2, "'INTERNAL'")} AS sensitivity_level,
      {_pii(3, "0.92::DOUBLE", text=False)} AS clf_confidence, {_pii(4, "''")} AS regulatory_domains FROM named_profile)""",
)


@query(
    "classify_pii",
    """SELECT table_name, column_name, is_pii, pii_type, sensitivity_level, clf_confidence AS confidence,
    array_to_string(clf_evidence, '|') AS evidence, regulatory_domains FROM pii_verdict""",
)
def classify_pii(e: Estate) -> DataFrame:
    found = annotated(e).select("table_name", "column_name", "classification.*")
    return found.withColumns({"evidence": joined(F.col("evidence")), "regulatory_domains": joined(F.col("regulatory_domains"), ",")})


@query(
    "classify_with_upstream",
    """SELECT table_name, column_name, is_pii OR inherited AS is_pii,
    CASE WHEN is_pii THEN pii_type WHEN inherited THEN 'CUSTOMER_ID' ELSE 'NONE' END AS pii_type,
    CASE WHEN is_pii THEN sensitivity_level WHEN inherited THEN 'RESTRICTED' ELSE 'INTERNAL' END AS sensitivity_level,
    CASE WHEN is_pii THEN clf_confidence WHEN inherited THEN 0.95::DOUBLE ELSE 0.92::DOUBLE END AS confidence,
    array_to_string(list_sort(list_distinct(list_filter(string_split(regulatory_domains, ','), lambda x: x <> '') || CASE WHEN inherited THEN ['GDPR', 'LGPD'] ELSE [] END)), ',') AS regulatory_domains
    FROM (SELECT *, (table_name || '.' || column_name) IN ('orders.o_totalprice', 'events.value', 'events.user_id') AS inherited
      FROM pii_verdict WHERE table_name IN ('orders', 'events', 'part'))""",
)
def classify_with_upstream(e: Estate) -> DataFrame:
    from tabellion.operators.profile import profile_tables

    tags = e.spark.createDataFrame(UPSTREAM, "table_name string, column_name string, tag_name string")
    profiles = profile_tables({t: e.table(t) for t in ("orders", "events", "part")})
    tagged = classify.with_upstream_tags(profiles, tags)
    found = tagged.select(
        "table_name", "column_name", classify.classification(RULES, F.col("upstream_tags")).alias("c")
    ).select("table_name", "column_name", "c.*")
    return found.drop("evidence").withColumn("regulatory_domains", joined(F.col("regulatory_domains"), ","))


MONEY = "regexp_matches(low, 'price|amount|revenue|spend|value|freight|total|brl|cost|gmv|ticket') OR list_contains(detected_patterns, 'NUMERIC_CURRENCY_PATTERN')"
DESCRIPTIONS = [
    ("contains(low, 'id') AND is_unique", "'Primary unique entity identifier for ' || table_name || ' records.'", "0.96", "'The name contains ''id'' and every value is unique.'"),
    ("contains(low, 'id')", "'Foreign key reference identifier associating records with upstream entity.'", "0.92", "'The name contains ''id'' and values repeat.'"),
    (MONEY, "'Monetary currency value representing transaction amount in Brazilian Real (BRL).'", "0.94", "'Type ' || data_type || ' with a money name or money values.'"),
    ("regexp_matches(low, 'date|time|at')", "'Temporal timestamp tracking event execution in lifecycle of ' || table_name || '.'", "0.95", "'The name refers to time.'"),
    ("regexp_matches(low, 'city|state|zip|postal|geo')", "'Geographic spatial location attribute defining territorial boundary or routing.'", "0.93", "'The name refers to a place.'"),
    ("regexp_matches(low, 'score|rating|satisfaction')", "'Numerical satisfaction assessment metric evaluating customer fulfillment experience.'", "0.94", "'Values from ' || COALESCE(min_value, 'none') || ' to ' || COALESCE(max_value, 'none') || ' fit a rating scale.'"),
]
define(
    "described",
    f"""SELECT *,
    {_chain([(c, t) for c, t, _, _ in DESCRIPTIONS], "'Business attribute defining ' || replace(column_name, '_', ' ') || ' within ' || table_name || '.'")} AS description,
    {_chain([(c, s + '::DOUBLE') for c, _, s, _ in DESCRIPTIONS], '0.88::DOUBLE')} AS desc_confidence,
    {_chain([(c, w) for c, _, _, w in DESCRIPTIONS], "'Taken from the table context and ' || distinct_count || ' distinct values.'")} AS reasoning,
    list_filter(['Type ' || data_type || ', ' || total_rows || ' rows, ' || null_percentage || '% null.',
      distinct_count || ' distinct values, ratio ' || cardinality_ratio || '.',
      CASE WHEN is_unique THEN 'Every value is unique (candidate key).' END,
      CASE WHEN len(detected_patterns) > 0 THEN 'Patterns: ' || array_to_string(detected_patterns, ', ') || '.' END,
      CASE WHEN len(neighbor_columns) > 0 THEN 'Neighbours: ' || array_to_string(neighbor_columns[1:4], ', ') || '.' END], lambda x: x IS NOT NULL) AS desc_evidence
    FROM pii_verdict""",
)


@query(
    "describe_columns",
    "SELECT table_name, column_name, description, desc_confidence AS confidence, array_to_string(desc_evidence, '|') AS evidence, reasoning FROM described",
)
def describe_columns(e: Estate) -> DataFrame:
    found = annotated(e).select("table_name", "column_name", "description.*")
    return found.withColumn("evidence", joined(F.col("evidence")))


TEST_GLOSSARY = {
    **classify.GLOSSARY,
    "o_totalprice": ("Order Grand Total", "Finance Domain", "Total amount of an order."),
    "l_extendedprice": ("Item Price", "Commerce Domain", "Line amount before discount."),
}
define(
    "mapped",
    """SELECT *, CASE low WHEN 'o_totalprice' THEN 'Order Grand Total' WHEN 'l_extendedprice' THEN 'Item Price' ELSE title END AS term_name,
    CASE low WHEN 'o_totalprice' THEN 'Finance Domain' WHEN 'l_extendedprice' THEN 'Commerce Domain' ELSE
      CASE WHEN regexp_matches(low, 'order|item|product') THEN 'Merchandise & Order Domain' WHEN regexp_matches(low, 'customer|buyer|user') THEN 'Customer Domain'
        WHEN regexp_matches(low, 'revenue|price|pay|spend') THEN 'Financial Analytics' WHEN regexp_matches(low, 'delivery|freight|carrier|ship') THEN 'Logistics Domain'
        ELSE 'Operations Domain' END END AS domain,
    CASE low WHEN 'o_totalprice' THEN 'Total amount of an order.' WHEN 'l_extendedprice' THEN 'Line amount before discount.'
      ELSE 'Standard business attribute representing ' || lower(title) || ' within ' || table_name || '.' END AS definition,
    low NOT IN ('o_totalprice', 'l_extendedprice') AS is_new_term,
    CASE WHEN low IN ('o_totalprice', 'l_extendedprice') THEN 0.98::DOUBLE ELSE 0.88::DOUBLE END AS gloss_confidence,
    CASE WHEN low IN ('o_totalprice', 'l_extendedprice') THEN ['Approved glossary entry for ''' || low || '''.']
      ELSE ['Term made from ' || table_name || '.' || column_name || '.', distinct_count || ' distinct values of type ' || data_type || '.'] END AS gloss_evidence
    FROM (SELECT *, array_to_string(list_transform(string_split(low, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM described)""",
)


def annotated_with_test_glossary(e: Estate) -> DataFrame:
    return classify.annotate(estate_profile(e), RULES, glossary=TEST_GLOSSARY)


@query(
    "map_glossary",
    """SELECT table_name, column_name, term_name, domain, definition, is_new_term, gloss_confidence AS confidence,
    array_to_string(gloss_evidence, '|') AS evidence FROM mapped""",
)
def map_glossary(e: Estate) -> DataFrame:
    found = annotated_with_test_glossary(e).select("table_name", "column_name", "glossary.*")
    return found.withColumn("evidence", joined(F.col("evidence")))


def _struct(kind: str, severity: str, why: str, low: str = "NULL", high: str = "NULL", pattern: str = "NULL", confidence: float = 0.0) -> str:
    return (
        f"{{'rule_type': '{kind}', 'min_value': CAST({low} AS DOUBLE), 'max_value': CAST({high} AS DOUBLE), "
        f"'pattern_name': CAST({pattern} AS VARCHAR), 'severity': '{severity}', 'confidence': {confidence}::DOUBLE, 'rationale': {why}}}"
    )


define(
    "ruled",
    f"""SELECT *, CASE WHEN len(rules) = 0 THEN 0.85::DOUBLE ELSE {half_up("list_sum(list_transform(rules, lambda r: CAST(ROUND(r.confidence * 100) AS BIGINT)))", "len(rules) * 100", 2)} END AS rule_confidence
    FROM (SELECT *, list_filter([
        CASE WHEN null_count = 0 AND total_rows > 0 THEN {_struct('NOT_NULL', 'ERROR', "'No null among ' || total_rows || ' rows.'", confidence=0.99)} END,
        CASE WHEN is_unique THEN {_struct('UNIQUE', 'ERROR', "'Every value is distinct.'", confidence=0.98)} END,
        CASE WHEN avg_value IS NOT NULL THEN {_struct('RANGE_CHECK', 'WARNING', "'Observed from ' || min_value || ' to ' || max_value || '.'", "CASE WHEN lo >= 0 THEN lo ELSE lo * 1.1::DOUBLE END", "hi * 1.5::DOUBLE", confidence=0.93)} END],
        lambda r: r IS NOT NULL)
      || list_transform(detected_patterns, lambda p: {_struct('PATTERN_MATCH', 'WARNING', "'Values follow ' || p || '.'", pattern='p', confidence=0.94)}) AS rules
    FROM (SELECT *, CASE WHEN avg_value IS NOT NULL THEN TRY_CAST(min_value AS DOUBLE) END AS lo, CASE WHEN avg_value IS NOT NULL THEN TRY_CAST(max_value AS DOUBLE) END AS hi FROM mapped))""",
)


@query(
    "propose_rules",
    """SELECT table_name, column_name, rule_confidence AS column_confidence, r.rule_type, r.min_value, r.max_value, r.pattern_name, r.severity, r.confidence, r.rationale
    FROM (SELECT table_name, column_name, rule_confidence, unnest(rules) AS r FROM ruled)""",
)
def propose_rules(e: Estate) -> DataFrame:
    listed = annotated(e).select(
        "table_name", "column_name", F.col("rules_confidence").alias("column_confidence"), F.explode("rules").alias("r")
    )
    return listed.select("table_name", "column_name", "column_confidence", "r.*").drop("column")


# a description that quotes its own sample values, as a careless author would write it
LEAKY = "Holds values such as "


def leaky(e: Estate) -> DataFrame:
    """Annotations whose description of the customer columns quotes the samples."""
    found = annotated_with_test_glossary(e)
    text = F.concat(F.lit(LEAKY), F.array_join("sample_values", ", "), F.lit("."))
    quoting = F.when(F.col("table_name") == "customer", text).otherwise(F.col("description.description"))
    unsure = F.when(F.col("table_name") == "nation", F.lit(0.5)).otherwise(F.col("description.confidence"))
    return found.withColumn(
        "description", F.col("description").withField("description", quoting).withField("confidence", unsure)
    )


define(
    "leaky_ruled",
    f"""SELECT * REPLACE (CASE WHEN table_name = 'customer' THEN '{LEAKY}' || array_to_string(sample_values, ', ') || '.' ELSE description END AS description,
    CASE WHEN table_name = 'nation' THEN 0.5::DOUBLE ELSE desc_confidence END AS desc_confidence) FROM ruled""",
)
define(
    "gated",
    """SELECT *, CASE WHEN is_pii THEN list_filter(list_transform(sample_values, lambda s: trim(s)), lambda s: length(s) >= 3 AND contains(lower(description), lower(s))) ELSE CAST([] AS VARCHAR[]) END AS leaks,
    NOT is_pii AND len(list_intersect(detected_patterns, ['EMAIL_PATTERN', 'PHONE_PATTERN', 'ZIP_PATTERN'])) > 0 AS disagree,
    least(desc_confidence, clf_confidence, gloss_confidence, rule_confidence) AS lowest FROM leaky_ruled""",
)
define(
    "reconciled_t",
    f"""SELECT table_name, column_name,
    list_reduce(list_prepend(description, leaks), lambda acc, v: regexp_replace(acc, '(?i)' || regexp_escape(v), '[REDACTED_PII]', 'g')) AS description,
    is_pii OR disagree AS is_pii,
    CASE WHEN disagree THEN CASE WHEN list_contains(detected_patterns, 'ZIP_PATTERN') THEN 'POSTAL_CODE' ELSE 'SENSITIVE' END ELSE pii_type END AS pii_type,
    sensitivity_level, term_name AS glossary_term, len(rules) AS suggested_rules_count,
    {half_up("CAST(ROUND(desc_confidence * 100) + ROUND(clf_confidence * 100) + ROUND(gloss_confidence * 100) + ROUND(rule_confidence * 100) AS BIGINT)", "400", 3)} AS overall_confidence,
    len(leaks) = 0 AND NOT disagree AND lowest >= 0.80 AS can_auto_write,
    list_transform(leaks, lambda s: {{'flag_type': 'PII_SAMPLE_LEAKAGE', 'severity': 'CRITICAL', 'description': 'Description shows the sample value ''' || s || '''.', 'action_taken': 'redacted and queued'}})
    || list_filter([CASE WHEN disagree THEN {{'flag_type': 'PATTERN_DISAGREEMENT', 'severity': 'WARNING', 'description': 'Values match ' || array_to_string(detected_patterns, ', ') || ' but the column was not classified as PII.', 'action_taken': 'marked as PII and queued'}} END,
      CASE WHEN lowest < 0.80 THEN {{'flag_type': 'LOW_CONFIDENCE', 'severity': 'WARNING', 'description': 'Lowest confidence ' || lowest || '.', 'action_taken': 'queued'}} END], lambda f: f IS NOT NULL) AS flags,
    list_transform(desc_evidence[1:2], lambda x: '[Describer] ' || x) || list_transform(clf_evidence[1:2], lambda x: '[Classifier] ' || x)
    || list_transform(gloss_evidence[1:1], lambda x: '[Glossary] ' || x) || list_transform(rules[1:1], lambda r: '[Quality] ' || r.rationale) AS reconciled_evidence
    FROM gated""",
)


@query(
    "reconcile_columns",
    """SELECT * REPLACE (array_to_string(list_transform(flags, lambda f: f.flag_type || ':' || f.severity || ':' || f.description), '|') AS flags,
    array_to_string(reconciled_evidence, '|') AS reconciled_evidence) FROM reconciled_t""",
)
def reconcile_columns(e: Estate) -> DataFrame:
    found = reconcile.reconcile(leaky(e))
    told = F.transform("flags", lambda f: F.concat_ws(":", f["flag_type"], f["severity"], f["description"]))
    return found.withColumns({"flags": joined(told), "reconciled_evidence": joined(F.col("reconciled_evidence"))})


@query("redact_descriptions", "SELECT table_name, column_name, description FROM reconciled_t WHERE contains(description, '[REDACTED_PII]')")
def redact_descriptions(e: Estate) -> DataFrame:
    found = reconcile.reconcile(leaky(e))
    return found.select("table_name", "column_name", "description").filter(F.col("description").contains(reconcile.REDACTED))


CONTEXT = ", ".join(f"'{c}': p.{c}" for c in reconcile.CONTEXT_FIELDS)
define(
    "accounts_t",
    f"""SELECT table_name, column_name, input_tokens, output_tokens,
    CAST(ROUND(input_tokens * 0.00000015 + output_tokens * 0.0000006, 6) AS DOUBLE) AS cost_usd, can_auto_write, flag_count
    FROM (SELECT r.table_name, r.column_name, length(CAST(to_json({{{CONTEXT}}}) AS VARCHAR) || ' | Lineage: None') // 4 + 120 AS input_tokens,
      length(CAST(to_json(r) AS VARCHAR)) // 4 + 80 AS output_tokens, r.can_auto_write, len(r.flags) AS flag_count
      FROM estate_profile p JOIN reconciled_t r ON p.table_name = r.table_name AND p.column_name = r.column_name)""",
)


@query("enrich_accounts", "SELECT * FROM accounts_t")
def enrich_accounts(e: Estate) -> DataFrame:
    return reconcile.account(leaky(e))


@query(
    "enrich_summary",
    """SELECT COUNT(*) AS total_columns_enriched, CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
    CAST(ROUND(SUM(CAST(cost_usd AS DECIMAL(18,6))), 4) AS DOUBLE) AS total_cost_usd,
    CAST(SUM(CAST(can_auto_write AS INTEGER)) AS BIGINT) AS auto_approved_count,
    CAST(SUM(CAST(NOT can_auto_write AS INTEGER)) AS BIGINT) AS queued_for_review_count,
    CAST(SUM(flag_count) AS BIGINT) AS reconciliation_flags_count FROM accounts_t""",
)
def enrich_summary(e: Estate) -> DataFrame:
    return reconcile.summarise(reconcile.account(leaky(e)))


@query(
    "pii_scan_documents",
    "\nUNION ALL\n".join(
        f"SELECT doc_id, '{name}' AS pattern, len(regexp_extract_all(text, '{p}')) AS hits FROM documents WHERE regexp_matches(text, '{p}')"
        for name, p in TEXT_PATTERNS.items()
    ),
)
def pii_scan_documents(e: Estate) -> DataFrame:
    return textscan.scan_text(e.table("documents"), "doc_id", "text")


def _redacted_sql(expression: str) -> str:
    for p in TEXT_PATTERNS.values():
        expression = f"regexp_replace({expression}, '{p}', '[REDACTED_PII]', 'g')"
    return expression


@query("redact_documents", f"SELECT doc_id, {_redacted_sql('text')} AS text FROM documents")
def redact_documents(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", textscan.redact_text(F.col("text")).alias("text"))
