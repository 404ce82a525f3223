"""Metrics: classifier, gate, answers, ablations, rubric, usage, result comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabellion.operators import admission, classify, evaluate, search
from tabellion.plans.binding import Estate
from tabellion.plans.catalog_queries import GATE_WORDS
from tabellion.plans.enrich_queries import RULES, annotated
from tabellion.plans.oracle import define, half_up
from tabellion.plans.profile_queries import estate_profile
from tabellion.plans.registry import query
from tabellion.session import checkpointed

# --- classifier metrics ---------------------------------------------------------------------

CONFUSION = f"""tp, fp, fn, tn, COALESCE({half_up('tp', '(tp + fp)', 4)}, 0.0) AS precision, COALESCE({half_up('tp', '(tp + fn)', 4)}, 0.0) AS recall,
    COALESCE({half_up('2 * tp', '(2 * tp + fp + fn)', 4)}, 0.0) AS f1_score, tp + fp + fn + tn AS total_evaluated"""


def counts_sql(actual: str, predicted: str) -> str:
    return f"""COUNT(*) FILTER (WHERE ({actual}) AND ({predicted})) AS tp, COUNT(*) FILTER (WHERE NOT ({actual}) AND ({predicted})) AS fp,
    COUNT(*) FILTER (WHERE ({actual}) AND NOT ({predicted})) AS fn, COUNT(*) FILTER (WHERE NOT ({actual}) AND NOT ({predicted})) AS tn"""


@query(
    "confusion_metrics",
    f"""SELECT lang, {CONFUSION} FROM (SELECT lang, {counts_sql('quality = 1', 'n_chars > 800 AND contains(text, chr(10))')} FROM labels JOIN documents USING (doc_id) GROUP BY lang)""",
)
def confusion_metrics(e: Estate) -> DataFrame:
    documents = e.table("documents").select("doc_id", "lang", ((F.col("n_chars") > 800) & F.col("text").contains("\n")).alias("said"))
    joined = e.table("labels").join(documents, "doc_id")
    return evaluate.confusion(joined, F.col("quality") == 1, F.col("said"), ["lang"])


# columns of the test tables that a reviewer marked as personal; the rest are not
GOLD_PII = [("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_acctbal"), ("supplier", "s_name"), ("orders", "o_custkey"), ("events", "user_id"), ("conversations", "text"), ("events", "props")]
GOLD_LIST = ", ".join(f"'{t}.{c}'" for t, c in GOLD_PII)


@query(
    "pii_eval",
    f"""SELECT s.*, b.f1_score AS baseline_f1, CAST(CAST(s.f1_score AS DECIMAL(10,4)) - CAST(b.f1_score AS DECIMAL(10,4)) AS DOUBLE) AS delta_f1
    FROM (SELECT split, {CONFUSION} FROM (SELECT split, {counts_sql('gold', 'is_pii')} FROM pii_split_t GROUP BY split)) s
    JOIN (SELECT split, {CONFUSION} FROM (SELECT split, {counts_sql('gold', 'plain_pii')} FROM pii_split_t GROUP BY split)) b USING (split)""",
)
def pii_eval(e: Estate) -> DataFrame:
    """The rules with the estate's own keywords against the same rules without them."""
    profiles = checkpointed(estate_profile(e))  # one row per column, read by both metrics
    key = F.concat_ws(".", "table_name", "column_name")
    gold = profiles.select(
        "table_name",
        "column_name",
        key.isin(*[f"{t}.{c}" for t, c in GOLD_PII]).alias("is_pii"),
        F.when(F.length("table_name") % 2 == 0, "held_out").otherwise("calibration").alias("split"),
        classify.classification(RULES)["is_pii"].alias("_own"),
        classify.classification()["is_pii"].alias("_base"),
    )
    own = evaluate.confusion(gold, F.col("is_pii"), F.col("_own"), ["split"])
    base = evaluate.confusion(gold, F.col("is_pii"), F.col("_base"), ["split"])
    return evaluate.with_baseline(own, base, ["split"])


define(
    "pii_split_t",
    f"""SELECT *, (table_name || '.' || column_name) IN ({GOLD_LIST}) AS gold, CASE WHEN length(table_name) % 2 = 0 THEN 'held_out' ELSE 'calibration' END AS split,
    is_pii AND NOT regexp_matches(plain, 'custkey|userid|cname|sname|acctbal') AS plain_pii FROM pii_verdict""",
)

# --- gate and load --------------------------------------------------------------------------

GATE_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in GATE_WORDS)


@query(
    "gate_eval",
    f"""SELECT a AS total_adversarial_prompts, blocked AS blocked_attacks, a - blocked AS leaked_attacks_count, {half_up('blocked', 'a', 2, 100)} AS governance_block_rate_pct,
    b AS total_benign_prompts, passed AS passed_benign_requests, b - passed AS false_refusal_count, {half_up('passed', 'b', 2, 100)} AS benign_pass_rate_pct,
    {half_up('(b - passed)', 'b', 2, 100)} AS false_refusal_rate_pct, {half_up('(blocked + passed)', '(a + b)', 2, 100)} AS overall_governance_accuracy_pct
    FROM (SELECT COUNT(*) FILTER (WHERE bad) AS a, COUNT(*) FILTER (WHERE NOT bad) AS b, COUNT(*) FILTER (WHERE bad AND hit) AS blocked, COUNT(*) FILTER (WHERE NOT bad AND NOT hit) AS passed
      FROM (SELECT {GATE_SQL} AS hit, length(text) % 3 <> 0 AS bad FROM conversations WHERE role = 'user'))""",
)
def gate_eval(e: Estate) -> DataFrame:
    prompts = e.table("conversations").filter(F.col("role") == "user")
    gated = search.gate_prompts(prompts, "text", triggers=GATE_WORDS)
    return evaluate.gate_scores(gated, F.col("status") == search.REFUSED, F.length("text") % 3 != 0)


def load_sql(microseconds: int) -> str:
    return f"""SELECT *, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{microseconds - 1} microseconds' PRECEDING AND CURRENT ROW) AS load FROM events"""


@query("request_load_60s", load_sql(60_000_000))
def request_load_60s(e: Estate) -> DataFrame:
    return admission.trailing_load(e.table("events"), "user_id", "ts", 60)


@query("request_load_1d", load_sql(86_400_000_000))
def request_load_1d(e: Estate) -> DataFrame:
    return admission.trailing_load(e.table("events"), "user_id", "ts", 86_400)


ADMISSION_SQL = """WITH RECURSIVE numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    decided AS (SELECT user_id, event_id, n, TRUE AS accepted, [ts] AS recent FROM numbered WHERE n = 1
      UNION ALL SELECT user_id, event_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END
      FROM (SELECT r.user_id, r.event_id, r.n, r.ts, list_filter(d.recent, lambda t: r.ts - t < INTERVAL 1 DAY) AS kept FROM decided d JOIN numbered r ON r.user_id = d.user_id AND r.n = d.n + 1))
    SELECT user_id, event_id, accepted FROM decided"""


@query("admission_control", ADMISSION_SQL)
def admission_control(e: Estate) -> DataFrame:
    return admission.admit(e.table("events"), "user_id", "ts", "event_id", 3, 86_400).select("user_id", "event_id", "accepted")


# --- answers, ablations ---------------------------------------------------------------------

CONDITIONS = {"full": 0, "no_lineage": 400, "no_glossary": 250, "bare": 60}


def gold_answers(e: Estate) -> DataFrame:
    """One question per nation: its customers and their balances."""
    customer = e.table("customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    return customer.select(F.col("c_nationkey").alias("question"), evaluate.row_text(customer.drop("c_nationkey")).alias("row"))


def given_answers(e: Estate) -> DataFrame:
    """The same answers per condition, with some balances wrong in the reduced conditions."""
    customer = e.table("customer")
    parts = []
    for condition, step in CONDITIONS.items():
        balance = F.col("c_acctbal")
        wrong = balance if not step else F.when(F.col("c_custkey") % step == 3, balance + 1).otherwise(balance)
        shown = customer.select("c_nationkey", "c_mktsegment", wrong.alias("c_acctbal"))
        parts.append(shown.select(F.lit(condition).alias("condition"), F.col("c_nationkey").alias("question"), evaluate.row_text(shown.drop("c_nationkey")).alias("row")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union


define(
    "answer_matches_t",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS condition, c_nationkey AS question, {'TRUE' if not s else f'COUNT(*) FILTER (WHERE c_custkey % {s} = 3) = 0'} AS matched FROM customer GROUP BY c_nationkey"
        for c, s in CONDITIONS.items()
    ),
)
ACCURACY = f"SELECT condition, COUNT(*) FILTER (WHERE matched) AS matches, COUNT(*) AS total_questions, {half_up('COUNT(*) FILTER (WHERE matched)', 'COUNT(*)', 2, 100)} AS accuracy_pct FROM answer_matches_t GROUP BY condition"


@query("answer_matches", "SELECT * FROM answer_matches_t")
def answer_matches(e: Estate) -> DataFrame:
    return evaluate.answer_matches(given_answers(e), gold_answers(e))


def accuracies(e: Estate) -> DataFrame:
    gold = gold_answers(e)
    return evaluate.answer_accuracy(evaluate.answer_matches(given_answers(e), gold), gold)


@query("answer_accuracy", ACCURACY)
def answer_accuracy(e: Estate) -> DataFrame:
    return accuracies(e)


@query("ablation_deltas", f"SELECT *, CAST(CAST(accuracy_pct AS DECIMAL(8,2)) - 100 AS DOUBLE) AS drop_points FROM ({ACCURACY})")
def ablation_deltas(e: Estate) -> DataFrame:
    return evaluate.ablation(accuracies(e), "full")


# --- result comparison ----------------------------------------------------------------------


@query(
    "result_diff",
    """SELECT CAST(COUNT(*) AS BIGINT) AS left_rows, CAST(COUNT(*) FILTER (WHERE o_orderkey % 70 <> 5) + COUNT(*) FILTER (WHERE o_orderkey % 90 = 0 AND o_orderkey % 70 <> 5) AS BIGINT) AS right_rows,
    CAST(COUNT(*) FILTER (WHERE o_orderkey % 70 = 5 OR o_orderkey % 31 = 4) AS BIGINT) AS missing_rows,
    CAST(COUNT(*) FILTER (WHERE o_orderkey % 70 <> 5 AND o_orderkey % 31 = 4) + COUNT(*) FILTER (WHERE o_orderkey % 90 = 0 AND o_orderkey % 70 <> 5) AS BIGINT) AS extra_rows, FALSE AS equal FROM orders""",
)
def result_diff(e: Estate) -> DataFrame:
    """Orders against a copy with lost, changed and repeated rows."""
    orders = e.table("orders")
    key = F.col("o_orderkey")
    changed = orders.filter(key % 70 != 5).withColumn("o_totalprice", F.when(key % 31 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 0.0001))
    recased = changed.withColumn("o_orderstatus", F.concat(F.lit(" "), F.lower("o_orderstatus")))
    return evaluate.result_diff(orders, recased.unionAll(recased.filter(key % 90 == 0)))


@query("result_diff_equal", "SELECT COUNT(*) AS left_rows, COUNT(*) AS right_rows, CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows, TRUE AS equal FROM dim_sellers_t")
def result_diff_equal(e: Estate) -> DataFrame:
    """A mart against itself with its rows reversed."""
    return evaluate.result_diff(e.dim_sellers, e.dim_sellers.orderBy(F.col("seller_id").desc()))


# --- rubric ---------------------------------------------------------------------------------

HALLUCINATED = f"""len(list_filter(list_intersect(regexp_split_to_array(lower(description), '[^a-z0-9_]+'), {list(evaluate.TYPE_NAMES)}), lambda t: t <> lower(data_type))) > 0"""
define(
    "rubric_t",
    f"""SELECT *, {half_up('CAST(ROUND((grounding + relevance + clarity) * 10) AS BIGINT)', '30', 2)} AS overall
    FROM (SELECT table_name, column_name, CASE WHEN contains(lower(description), lower(data_type)) OR contains(low, 'id') THEN 4.6::DOUBLE ELSE 4.3::DOUBLE END AS grounding,
    CASE WHEN regexp_matches(lower(description), 'identifier|currency|amount|timestamp|attribute|metric|customer|order|price') THEN 4.8::DOUBLE ELSE 4.2::DOUBLE END AS relevance,
    CASE WHEN length(description) > 25 THEN 4.8::DOUBLE ELSE 3.8::DOUBLE END AS clarity, {HALLUCINATED} AS hallucinated FROM described)""",
)


def scored(e: Estate) -> DataFrame:
    described = annotated(e).select("table_name", "column_name", "data_type", F.col("description.description").alias("description"))
    return evaluate.rubric(described)


@query("rubric_scores", "SELECT * FROM rubric_t")
def rubric_scores(e: Estate) -> DataFrame:
    return scored(e).drop("data_type", "description")


def _mean(column: str) -> str:
    return half_up(f"CAST(SUM(CAST(ROUND({column} * 100) AS BIGINT)) AS BIGINT)", "(COUNT(*) * 100)", 2)


RUBRIC_SUMMARY = f"""SELECT COUNT(*) AS samples_evaluated, {_mean('overall')} AS mean_rubric_score_out_of_5, {_mean('grounding')} AS technical_grounding,
    {_mean('relevance')} AS domain_relevance, {_mean('clarity')} AS clarity, COUNT(*) FILTER (hallucinated) AS hallucinations_detected_count, COALESCE({half_up('COUNT(*) FILTER (hallucinated)', 'COUNT(*)', 3)}, 0.0) AS hallucination_rate FROM rubric_t"""


@query("rubric_summary", RUBRIC_SUMMARY)
def rubric_summary(e: Estate) -> DataFrame:
    return evaluate.rubric_summary(scored(e))


# --- usage ----------------------------------------------------------------------------------

# prices per million tokens (input, output) of three made-up models
PRICES = {"user": ("0.10", "0.40"), "assistant": ("0.075", "0.30"), "default": ("0.15", "0.60")}


def calls(e: Estate) -> DataFrame:
    """Each turn as a model call: the role is the model, the text the tokens, the turn the latency."""
    tokens = evaluate.estimated_tokens("text")
    turns = e.table("conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("model"),
        tokens.alias("input_tokens"),
        F.floor(tokens / 2).alias("output_tokens"),
        (F.col("turn") * 12.25).alias("latency_ms"),
    )
    return evaluate.priced(turns, PRICES, "default")


define(
    "calls_t",
    """SELECT *, (input_tokens * i + output_tokens * o + 500) // 1000 AS micro, CAST((input_tokens * i + output_tokens * o + 500) // 1000 AS DOUBLE) / 1000000 AS cost_usd
    FROM (SELECT conv_id, turn, role AS model, length(text) // 4 AS input_tokens, length(text) // 4 // 2 AS output_tokens, turn * 12.25::DOUBLE AS latency_ms,
      CASE role WHEN 'user' THEN 100 WHEN 'assistant' THEN 75 ELSE 150 END AS i, CASE role WHEN 'user' THEN 400 WHEN 'assistant' THEN 300 ELSE 600 END AS o FROM conversations)""",
)

@query("usage_cost", "SELECT conv_id, turn, model, input_tokens, output_tokens, latency_ms, cost_usd FROM calls_t")
def usage_cost(e: Estate) -> DataFrame:
    return calls(e)


def usage_sql(by: str) -> str:
    return f"""SELECT {by} COUNT(*) AS total_entries, CAST(SUM(input_tokens) AS BIGINT) AS total_input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS total_tokens, CAST(SUM(micro) AS DOUBLE) / 1000000 AS total_cost_usd,
    {half_up('CAST(SUM(micro) AS BIGINT)', '(COUNT(*) * 1000)', 4)} AS cost_per_1k_calls, {half_up('CAST(SUM(turn * 1225) AS BIGINT)', '(COUNT(*) * 100)', 2)} AS avg_latency_ms
    FROM calls_t {'GROUP BY model' if by else ''}"""


@query("usage_rollup", usage_sql("model,"))
def usage_rollup(e: Estate) -> DataFrame:
    return evaluate.usage(calls(e), ["model"])


@query("usage_total", usage_sql(""))
def usage_total(e: Estate) -> DataFrame:
    return evaluate.usage(calls(e))


@query(
    "json_extract_from_text",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props AS object FROM events",
)
def json_extract_from_text(e: Estate) -> DataFrame:
    """The props object, found again inside chatty text, fenced or not."""
    props = F.col("props")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone {ok}."))).otherwise(
        F.concat(F.lit("  The answer is "), props, F.lit(" as asked."))
    )
    found = evaluate.extract_json(said)
    return e.table("events").select("event_id", F.from_json(found, "k int")["k"].alias("k"), found.alias("object"))


# --- one table of metrics -------------------------------------------------------------------


@query(
    "benchmark_summary",
    f"""SELECT 'answer_accuracy_full' AS metric, accuracy_pct AS value FROM ({ACCURACY}) WHERE condition = 'full'
    UNION ALL SELECT 'answer_accuracy_bare', accuracy_pct FROM ({ACCURACY}) WHERE condition = 'bare'
    UNION ALL SELECT 'description_quality', mean_rubric_score_out_of_5 FROM ({RUBRIC_SUMMARY})
    UNION ALL SELECT 'cost_per_1k_calls', cost_per_1k_calls FROM ({usage_sql('')})
    UNION ALL SELECT 'lineage_accuracy', {half_up('COUNT(*) FILTER (WHERE missing = 0)', 'COUNT(*)', 2, 100)} FROM lineage_verdicts_t""",
)
def benchmark_summary(e: Estate) -> DataFrame:
    from tabellion.plans.lineage_queries import lineage_accuracy

    accuracy = accuracies(e)
    return evaluate.metrics_table(
        {
            "answer_accuracy_full": (accuracy.filter("condition = 'full'"), "accuracy_pct"),
            "answer_accuracy_bare": (accuracy.filter("condition = 'bare'"), "accuracy_pct"),
            "description_quality": (rubric_summary(e), "mean_rubric_score_out_of_5"),
            "cost_per_1k_calls": (usage_total(e), "cost_per_1k_calls"),
            "lineage_accuracy": (lineage_accuracy(e), "accuracy_percentage"),
        }
    )
