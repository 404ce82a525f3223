"""Quality rules, table scores and the defect benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.patterns import VALUE_PATTERNS
from tabellion.operators import classify, defects, quality
from tabellion.operators.profile import profile_tables
from tabellion.operators.quality import Rule
from tabellion.plans.binding import Estate
from tabellion.plans.oracle import half_up
from tabellion.plans.profile_queries import strip, table_profile_sql
from tabellion.plans.registry import query, register
from tabellion.plans.schemas import SCHEMAS


def result_sql(table: str, kind: str, column: str, severity: str, failing: str, source: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{kind}' AS rule_type, '{column}' AS column_name, '{severity}' AS severity,
    failing = 0 AS passed, failing AS failing_rows_count, total AS total_rows_count
    FROM (SELECT CAST({failing} AS BIGINT) AS failing, COUNT(*) AS total FROM {source})"""


def holed(e: Estate, table: str, column: str, key: str) -> DataFrame:
    """A table with every 97th value of a column removed."""
    return e.table(table).withColumn(column, F.when(F.col(key) % 97 != 0, F.col(column)))


def holed_sql(table: str, column: str, key: str) -> str:
    return f"(SELECT * REPLACE (CASE WHEN {key} % 97 <> 0 THEN {column} END AS {column}) FROM {table})"


def failing_if(condition: str) -> str:
    return f"COALESCE(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END), 0)"


register(
    "rule_not_null",
    lambda e: quality.run_rules({"orders": holed(e, "orders", "o_custkey", "o_orderkey")}, [Rule("orders", "NOT_NULL", "o_custkey"), Rule("orders", "NOT_NULL", "o_orderdate")]),
    result_sql("orders", "NOT_NULL", "o_custkey", "ERROR", failing_if("o_custkey IS NULL"), holed_sql("orders", "o_custkey", "o_orderkey"))
    + "\nUNION ALL\n"
    + result_sql("orders", "NOT_NULL", "o_orderdate", "ERROR", failing_if("o_orderdate IS NULL"), "orders"),
)
register(
    "rule_unique",
    lambda e: quality.run_rules(
        {"orders": e.table("orders"), "lineitem": e.table("lineitem")},
        [
            Rule("orders", "UNIQUE", "o_orderkey"),
            Rule("lineitem", "UNIQUE", "l_orderkey", columns=("l_orderkey", "l_linenumber")),
        ],
    ),
    result_sql("orders", "UNIQUE", "o_orderkey", "ERROR", "COUNT(o_orderkey) - COUNT(DISTINCT o_orderkey)", "orders")
    + "\nUNION ALL\n"
    + result_sql("lineitem", "UNIQUE", "l_orderkey,l_linenumber", "ERROR", "COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber))", "lineitem"),
)
register(
    "rule_range",
    lambda e: quality.run_rules(
        {"customer": e.table("customer"), "part": holed(e, "part", "p_size", "p_partkey")},
        [
            Rule("customer", "RANGE_CHECK", "c_acctbal", "WARNING", low=0.0, high=9000.0),
            Rule("part", "RANGE_CHECK", "p_size", low=1, high=45),
        ],
    ),
    result_sql("customer", "RANGE_CHECK", "c_acctbal", "WARNING", failing_if("c_acctbal < 0 OR c_acctbal > 9000"), "customer")
    + "\nUNION ALL\n"
    + result_sql("part", "RANGE_CHECK", "p_size", "ERROR", failing_if("p_size < 1 OR p_size > 45"), holed_sql("part", "p_size", "p_partkey")),
)
register(
    "rule_pattern",
    lambda e: quality.run_rules(
        {"part": e.table("part"), "orders": e.table("orders"), "pages": e.table("pages")},
        [
            Rule("part", "PATTERN_MATCH", "p_brand", "WARNING", pattern=r"^Brand#[0-9]\z"),
            Rule("orders", "PATTERN_MATCH", "o_orderdate", "WARNING", pattern="DATE_ISO_PATTERN"),
            Rule("orders", "PATTERN_MATCH", "o_orderkey", "WARNING", pattern="ZIP_PATTERN"),
            Rule("pages", "PATTERN_MATCH", "url", pattern=r"^https://"),
        ],
    ),
    "\nUNION ALL\n".join(
        [
            result_sql("part", "PATTERN_MATCH", "p_brand", "WARNING", failing_if("NOT regexp_matches(trim(p_brand), '^Brand#[0-9]\\z')"), "part"),
            result_sql("orders", "PATTERN_MATCH", "o_orderdate", "WARNING", failing_if("NOT regexp_matches(CAST(o_orderdate AS VARCHAR), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')"), "orders"),
            result_sql("orders", "PATTERN_MATCH", "o_orderkey", "WARNING", failing_if("NOT regexp_matches(CAST(o_orderkey AS VARCHAR), '^[0-9]{4,5}(-[0-9]{3,4})?\\z')"), "orders"),
            result_sql("pages", "PATTERN_MATCH", "url", "ERROR", failing_if("NOT starts_with(url, 'https://')"), "pages"),
        ]
    ),
)
register(
    "rule_referential_integrity",
    lambda e: quality.run_rules(
        {
            "lineitem": e.table("lineitem"),
            "orders": e.table("orders").filter(F.col("o_orderkey") % 50 != 0),
            "customer": e.table("customer"),
        },
        [
            Rule("lineitem", "REFERENTIAL_INTEGRITY", "l_orderkey", ref_table="orders", ref_column="o_orderkey"),
            Rule("orders", "REFERENTIAL_INTEGRITY", "o_custkey", ref_table="customer", ref_column="c_custkey"),
        ],
    ),
    result_sql("lineitem", "REFERENTIAL_INTEGRITY", "l_orderkey", "ERROR", failing_if("l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)"), "lineitem")
    + "\nUNION ALL\n"
    + result_sql("orders", "REFERENTIAL_INTEGRITY", "o_custkey", "ERROR", failing_if("o_custkey NOT IN (SELECT c_custkey FROM customer)"), "(FROM orders WHERE o_orderkey % 50 <> 0)"),
)


def dated_items(e: Estate) -> DataFrame:
    placed = e.table("orders").select("o_orderkey", "o_orderdate")
    items = e.table("lineitem").select("l_orderkey", "l_shipdate")
    return items.join(placed, F.col("l_orderkey") == F.col("o_orderkey"), "left")


register(
    "rule_temporal_order",
    lambda e: quality.run_rules({"lineitem": dated_items(e)}, [Rule("lineitem", "TEMPORAL_ORDER", "l_shipdate", other="o_orderdate")]),
    result_sql("lineitem", "TEMPORAL_ORDER", "l_shipdate", "ERROR", failing_if("l_shipdate < o_orderdate"), "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"),
)
register(
    "rule_reconcile_totals",
    lambda e: quality.run_rules(
        {
            "fct_orders": e.fct_orders.withColumn(
                "grand_total_brl", F.when(F.col("order_id") % 90 == 0, 0.05).otherwise(F.col("grand_total_brl"))
            ),
            "stg_order_items": e.stg_order_items,
        },
        [Rule("fct_orders", "RECONCILE_TOTAL", "grand_total_brl", ref_table="stg_order_items", key="order_id", detail="item_price + freight_value", tolerance=0.01)],
    ),
    result_sql(
        "fct_orders",
        "RECONCILE_TOTAL",
        "grand_total_brl",
        "ERROR",
        failing_if("abs(CAST(CASE WHEN order_id % 90 = 0 THEN 0.05 ELSE grand_total_brl END AS DECIMAL(18,4)) - COALESCE(total, 0)) > 0.01"),
        "fct_orders_t LEFT JOIN (SELECT order_id, SUM(CAST(item_price + freight_value AS DECIMAL(18,4))) AS total FROM stg_order_items_t GROUP BY order_id) USING (order_id)",
    ),
)

TABLE_RULES = [
    Rule("orders", "NOT_NULL", "o_custkey"),
    Rule("orders", "UNIQUE", "o_orderkey"),
    Rule("orders", "RANGE_CHECK", "o_totalprice", "WARNING", low=0.0, high=400000.0),
    Rule("customer", "NOT_NULL", "c_name"),
    Rule("customer", "UNIQUE", "c_custkey"),
    Rule("customer", "RANGE_CHECK", "c_acctbal", "WARNING", low=-1000.0, high=10000.0),
    Rule("lineitem", "UNIQUE", "l_orderkey", columns=("l_orderkey", "l_linenumber")),
    Rule("lineitem", "RANGE_CHECK", "l_discount", "WARNING", low=0.0, high=0.05),
    Rule("part", "PATTERN_MATCH", "p_brand", "WARNING", pattern=r"^Brand#[0-9]+\z"),
    Rule("part", "NOT_NULL", "p_type"),
    Rule("part", "RANGE_CHECK", "p_size", "WARNING", low=1, high=40),
    Rule("part", "UNIQUE", "p_partkey"),
    Rule("part", "NOT_NULL", "p_name"),
    Rule("part", "NOT_NULL", "p_brand"),
]
SCORED = ["orders", "customer", "lineitem", "part", "region"]
TABLE_RESULTS_SQL = "\nUNION ALL\n".join(
    [
        result_sql("orders", "NOT_NULL", "o_custkey", "ERROR", failing_if("o_custkey IS NULL"), "orders"),
        result_sql("orders", "UNIQUE", "o_orderkey", "ERROR", "COUNT(o_orderkey) - COUNT(DISTINCT o_orderkey)", "orders"),
        result_sql("orders", "RANGE_CHECK", "o_totalprice", "WARNING", failing_if("o_totalprice < 0 OR o_totalprice > 400000"), "orders"),
        result_sql("customer", "NOT_NULL", "c_name", "ERROR", failing_if("c_name IS NULL"), "customer"),
        result_sql("customer", "UNIQUE", "c_custkey", "ERROR", "COUNT(c_custkey) - COUNT(DISTINCT c_custkey)", "customer"),
        result_sql("customer", "RANGE_CHECK", "c_acctbal", "WARNING", failing_if("c_acctbal < -1000 OR c_acctbal > 10000"), "customer"),
        result_sql("lineitem", "UNIQUE", "l_orderkey,l_linenumber", "ERROR", "COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber))", "lineitem"),
        result_sql("lineitem", "RANGE_CHECK", "l_discount", "WARNING", failing_if("l_discount < 0 OR l_discount > 0.05::DOUBLE"), "lineitem"),
        result_sql("part", "PATTERN_MATCH", "p_brand", "WARNING", failing_if("NOT regexp_matches(p_brand, '^Brand#[0-9]+\\z')"), "part"),
        result_sql("part", "NOT_NULL", "p_type", "ERROR", failing_if("p_type IS NULL"), "part"),
        result_sql("part", "RANGE_CHECK", "p_size", "WARNING", failing_if("p_size < 1 OR p_size > 40"), "part"),
        result_sql("part", "UNIQUE", "p_partkey", "ERROR", "COUNT(p_partkey) - COUNT(DISTINCT p_partkey)", "part"),
        result_sql("part", "NOT_NULL", "p_name", "ERROR", failing_if("p_name IS NULL"), "part"),
        result_sql("part", "NOT_NULL", "p_brand", "ERROR", failing_if("p_brand IS NULL"), "part"),
    ]
)
SCORES_SQL = f"""SELECT table_name, COUNT(rule_type) AS total_rules, COUNT(rule_type) FILTER (WHERE passed) AS passed_rules,
    COUNT(rule_type) FILTER (WHERE NOT passed) AS failed_rules,
    COALESCE({half_up('CAST(SUM(CASE WHEN passed THEN w ELSE 0 END) AS BIGINT)', 'CAST(SUM(w) AS BIGINT)', 3)}, 1.0) AS quality_score,
    COUNT(rule_type) FILTER (WHERE NOT passed AND severity = 'ERROR') AS error_failures
    FROM (SELECT unnest(['orders', 'customer', 'lineitem', 'part', 'region']) AS table_name)
    LEFT JOIN (SELECT *, CASE severity WHEN 'ERROR' THEN 2 ELSE 1 END AS w FROM ({TABLE_RESULTS_SQL})) USING (table_name) GROUP BY table_name"""
TABLE_SCORES_SQL = f"SELECT *, quality_score >= 0.85 AND error_failures = 0 AS can_certify FROM ({SCORES_SQL})"


def table_results(e: Estate) -> DataFrame:
    return quality.run_rules({t: e.table(t) for t in SCORED}, TABLE_RULES)


def table_scores(e: Estate) -> DataFrame:
    names = e.spark.createDataFrame([(t,) for t in SCORED], "table_name string")
    return quality.score_tables(table_results(e), names)


register("quality_rule_results", table_results, TABLE_RESULTS_SQL)
register("table_quality", table_scores, TABLE_SCORES_SQL)


def proposed_patterns_sql(table: str) -> str:
    """A pattern rule for each pattern that the samples of a column show, with the values that break it."""
    return "\nUNION ALL\n".join(
        f"""SELECT column_name, 'PATTERN_MATCH', 'WARNING', (SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL AND NOT regexp_matches({strip(f'CAST({c} AS VARCHAR)')}, '{p}'))
        FROM prof WHERE column_name = '{c}' AND list_contains(detected_patterns, '{name}')"""
        for c, _ in SCHEMAS[table]
        for name, p in VALUE_PATTERNS.items()
    )


@query(
    "proposed_rule_results",
    f"""WITH prof AS ({table_profile_sql('customer')})
    SELECT 'customer' AS table_name, rule_type, column_name, severity, failing = 0 AS passed, CAST(failing AS BIGINT) AS failing_rows_count, (SELECT COUNT(*) FROM customer) AS total_rows_count
    FROM (SELECT column_name, 'NOT_NULL' AS rule_type, 'ERROR' AS severity, 0 AS failing FROM prof WHERE null_count = 0 AND total_rows > 0
      UNION ALL SELECT column_name, 'UNIQUE', 'ERROR', 0 FROM prof WHERE is_unique
      UNION ALL SELECT column_name, 'RANGE_CHECK', 'WARNING', 0 FROM prof WHERE avg_value IS NOT NULL
      UNION ALL {proposed_patterns_sql('customer')})""",
)
def proposed_rule_results(e: Estate) -> DataFrame:
    """The rules proposed for a table, run against that table."""
    customer = e.table("customer")
    annotated = classify.annotate(profile_tables({"customer": customer}))
    proposals = annotated.select("table_name", F.explode("rules").alias("r")).select(
        "table_name", F.col("r.column").alias("column_name"), "r.rule_type", "r.severity", "r.min_value", "r.max_value", "r.pattern_name"
    )
    return quality.run_rules({"customer": customer}, quality.proposals_to_rules(proposals))


register(
    "table_row_counts",
    lambda e: quality.row_counts({t: e.table(t) for t in SCHEMAS}),
    "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, COUNT(*) > 0 AS has_rows FROM {t}" for t in SCHEMAS),
)

LOST = 1_000_000_000_000
DEFECTS = [
    defects.Defect("DEF-001", "NULL_VALUE", "stg_orders", "order_id", "order_id", 12, defects.overwrite("order_id", "NULL")),
    defects.Defect("DEF-002", "DUPLICATE_KEY", "dim_products", "product_id", "product_id", 8, defects.duplicate),
    defects.Defect("DEF-003", "OUT_OF_RANGE", "stg_order_items", "item_price", "order_id", 5, defects.overwrite("item_price", "-250.0")),
    defects.Defect("DEF-004", "OUT_OF_RANGE", "stg_reviews", "review_score", "review_id", 7, defects.overwrite("review_score", "99")),
    defects.Defect("DEF-005", "NULL_VALUE", "dim_customers", "customer_unique_id", "primary_zip", 10, defects.overwrite("customer_unique_id", "NULL")),
    defects.Defect(
        "DEF-006",
        "TEMPORAL_INVERSION",
        "stg_orders",
        "delivered_customer_at",
        "order_id",
        6,
        defects.overwrite("delivered_customer_at", "purchase_timestamp - INTERVAL 5 DAYS"),
        where="order_id IS NOT NULL",
    ),
    defects.Defect(
        "DEF-007",
        "AMOUNT_DRIFT",
        "fct_orders",
        "grand_total_brl",
        "order_id",
        4,
        defects.overwrite("grand_total_brl", "0.05"),
        where="total_order_items > 1",
    ),
    defects.Defect("DEF-008", "ORPHAN_ROWS", "stg_payments", "order_id", "order_id", 2, defects.orphan("order_id", LOST), added=True),
]
BASIC_SUITE = [
    Rule("stg_orders", "NOT_NULL", "order_id"),
    Rule("dim_products", "UNIQUE", "product_id"),
    Rule("stg_order_items", "RANGE_CHECK", "item_price", low=0.01, high=1000000.0),
    Rule("stg_reviews", "RANGE_CHECK", "review_score", low=1, high=5),
    Rule("dim_customers", "NOT_NULL", "customer_unique_id"),
]
FULL_SUITE = BASIC_SUITE + [
    Rule("stg_orders", "TEMPORAL_ORDER", "delivered_customer_at", other="purchase_timestamp"),
    Rule("fct_orders", "RECONCILE_TOTAL", "grand_total_brl", ref_table="stg_order_items", key="order_id", detail="item_price + freight_value", tolerance=0.01),
    Rule("stg_payments", "REFERENTIAL_INTEGRITY", "order_id", ref_table="raw_orders", ref_column="order_id"),
]


def clean_tables(e: Estate) -> dict[str, DataFrame]:
    names = ["stg_orders", "dim_products", "stg_order_items", "stg_reviews", "dim_customers", "fct_orders", "stg_payments", "raw_orders"]
    return {name: getattr(e, name) for name in names}


MANIFEST_SQL = """SELECT 'DEF-001' AS defect_id, 'NULL_VALUE' AS defect_type, 'stg_orders' AS table_name, 'order_id' AS column_name, COUNT(*) AS injected_count
      FROM stg_orders_t WHERE order_id IN (SELECT DISTINCT order_id FROM stg_orders_t ORDER BY 1 LIMIT 12)
    UNION ALL SELECT 'DEF-002', 'DUPLICATE_KEY', 'dim_products', 'product_id', COUNT(*) FROM dim_products_t WHERE product_id IN (SELECT DISTINCT product_id FROM dim_products_t ORDER BY 1 LIMIT 8)
    UNION ALL SELECT 'DEF-003', 'OUT_OF_RANGE', 'stg_order_items', 'item_price', COUNT(*) FROM stg_order_items_t WHERE order_id IN (SELECT DISTINCT order_id FROM stg_order_items_t ORDER BY 1 LIMIT 5)
    UNION ALL SELECT 'DEF-004', 'OUT_OF_RANGE', 'stg_reviews', 'review_score', COUNT(*) FROM stg_reviews_t WHERE review_id IN (SELECT DISTINCT review_id FROM stg_reviews_t ORDER BY 1 LIMIT 7)
    UNION ALL SELECT 'DEF-005', 'NULL_VALUE', 'dim_customers', 'customer_unique_id', COUNT(*) FROM dim_customers_t WHERE primary_zip IN (SELECT DISTINCT primary_zip FROM dim_customers_t ORDER BY 1 LIMIT 10)
    UNION ALL SELECT 'DEF-006', 'TEMPORAL_INVERSION', 'stg_orders', 'delivered_customer_at', COUNT(*) FROM stg_orders_t WHERE order_id IN (
        SELECT order_id FROM stg_orders_t WHERE order_id NOT IN (SELECT DISTINCT order_id FROM stg_orders_t ORDER BY 1 LIMIT 12) ORDER BY 1 LIMIT 6)
    UNION ALL SELECT 'DEF-007', 'AMOUNT_DRIFT', 'fct_orders', 'grand_total_brl', COUNT(*) FROM fct_orders_t WHERE order_id IN (SELECT order_id FROM fct_orders_t WHERE total_order_items > 1 ORDER BY 1 LIMIT 4)
    UNION ALL SELECT 'DEF-008', 'ORPHAN_ROWS', 'stg_payments', 'order_id', COUNT(*) FROM stg_payments_t WHERE order_id IN (SELECT DISTINCT order_id FROM stg_payments_t ORDER BY 1 LIMIT 2)"""

register("defect_inject", lambda e: defects.inject(clean_tables(e), DEFECTS)[1], MANIFEST_SQL)
SUITES = {"basic": BASIC_SUITE, "full": FULL_SUITE}
register(
    "defect_catches",
    lambda e: defects.benchmark(clean_tables(e), DEFECTS, SUITES)[0],
    f"""SELECT *, suite = 'full' OR defect_id NOT IN ('DEF-006', 'DEF-007', 'DEF-008') AS caught
    FROM ({MANIFEST_SQL}), (SELECT unnest(['basic', 'full']) AS suite)""",
)
register(
    "defect_catch_report",
    lambda e: defects.benchmark(clean_tables(e), DEFECTS, SUITES)[1],
    f"""SELECT suite, COUNT(*) AS total_injected_defects, CAST(SUM(CAST(caught AS INTEGER)) AS BIGINT) AS caught_defects,
    CAST(SUM(CAST(NOT caught AS INTEGER)) AS BIGINT) AS missed_defects,
    {half_up('CAST(SUM(CAST(caught AS INTEGER)) AS BIGINT)', 'COUNT(*)', 2, 100)} AS catch_rate_percentage,
    CAST(MAX(CASE WHEN suite = 'full' AND EXISTS (SELECT 1 FROM stg_orders_t WHERE delivered_customer_at < purchase_timestamp) THEN 1 ELSE 0 END) AS BIGINT) AS false_positives
    FROM (SELECT suite, suite = 'full' OR defect_id NOT IN ('DEF-006', 'DEF-007', 'DEF-008') AS caught
      FROM ({MANIFEST_SQL}), (SELECT unnest(['basic', 'full']) AS suite)) GROUP BY suite""",
)
