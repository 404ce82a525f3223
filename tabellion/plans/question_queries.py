"""The business questions: one small aggregate over a mart each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.columns import mean_money, money, sum_money
from tabellion.plans.oracle import money_mean, money_sum
from tabellion.plans.registry import register


def overall(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.agg(*aggregates)


def by(df: DataFrame, key: str, name: str, aggregate: Column, top: int | None = None) -> DataFrame:
    """Aggregate per key, largest first (ties by key); ``top`` keeps the first rows only."""
    ordered = df.groupBy(key).agg(aggregate.alias(name)).orderBy(F.col(name).desc(), F.col(key))
    return ordered.limit(top) if top else ordered


def rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _count(table: str, name: str, where: str = "TRUE") -> str:
    return f"SELECT COUNT(*) AS {name} FROM {table} WHERE {where}"


def _one(table: str, name: str, expression: str, where: str = "TRUE") -> str:
    return f"SELECT {expression} AS {name} FROM {table} WHERE {where}"


def _by(table: str, key: str, name: str, expression: str, top: int | None = None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return f"SELECT {key}, {expression} AS {name} FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY {name} DESC, {key}{limit}"


def _int_sum(expression: str) -> str:
    return f"CAST(SUM({expression}) AS BIGINT)"


def question(number: int, build, oracle: str) -> None:
    register(f"q{number:02d}", build, oracle)


question(1, lambda e: overall(e.fct_orders, rows("total_orders")), _count("fct_orders_t", "total_orders"))
question(
    2,
    lambda e: overall(e.fct_orders, sum_money("grand_total_brl").alias("total_revenue")),
    _one("fct_orders_t", "total_revenue", money_sum("grand_total_brl")),
)
question(
    3,
    lambda e: overall(e.fct_orders, mean_money("customer_review_score").alias("avg_csat")),
    _one("fct_orders_t", "avg_csat", money_mean("customer_review_score")),
)
question(
    4,
    lambda e: overall(e.dim_customers, F.countDistinct("customer_unique_id").alias("unique_customers")),
    _one("dim_customers_t", "unique_customers", "COUNT(DISTINCT customer_unique_id)"),
)
question(
    5,
    lambda e: by(e.dim_customers, "buyer_type", "buyer_count", F.count(F.lit(1))),
    _by("dim_customers_t", "buyer_type", "buyer_count", "COUNT(*)"),
)
question(
    6,
    lambda e: by(e.customer_ltv, "ltv_segment", "segment_revenue", sum_money("total_lifetime_spend_brl")),
    _by("customer_ltv_t", "ltv_segment", "segment_revenue", money_sum("total_lifetime_spend_brl")),
)
question(
    7,
    lambda e: by(e.customer_ltv, "ltv_segment", "customer_count", F.count(F.lit(1))),
    _by("customer_ltv_t", "ltv_segment", "customer_count", "COUNT(*)"),
)
question(
    8,
    lambda e: by(e.customer_ltv, "ltv_segment", "avg_ticket", mean_money("avg_order_ticket_brl")),
    _by("customer_ltv_t", "ltv_segment", "avg_ticket", money_mean("avg_order_ticket_brl")),
)
question(
    9,
    lambda e: overall(e.fct_orders, F.count_if("is_delayed_delivery").alias("delayed_count")),
    _one("fct_orders_t", "delayed_count", _int_sum("CASE WHEN is_delayed_delivery THEN 1 ELSE 0 END")),
)
question(
    10,
    lambda e: by(
        e.fct_orders.filter(F.col("customer_city").isNotNull()), "customer_city", "order_vol", F.count(F.lit(1)), top=5
    ),
    _by("fct_orders_t", "customer_city", "order_vol", "COUNT(*)", 5),
)
question(
    11,
    lambda e: by(e.mart_geo_performance, "customer_city", "gmv", sum_money("regional_gmv_brl"), top=5),
    _by("mart_geo_t", "customer_city", "gmv", money_sum("regional_gmv_brl"), 5),
)
question(
    12,
    lambda e: by(e.mart_geo_performance, "state_code", "avg_delay_pct", mean_money("delay_rate_percentage"), top=3),
    _by("mart_geo_t", "state_code", "avg_delay_pct", money_mean("delay_rate_percentage"), 3),
)
question(13, lambda e: overall(e.dim_products, rows("total_products")), _count("dim_products_t", "total_products"))
question(
    14,
    lambda e: by(e.dim_products, "weight_class", "product_count", F.count(F.lit(1))),
    _by("dim_products_t", "weight_class", "product_count", "COUNT(*)"),
)
question(
    15,
    lambda e: by(e.dim_products, "product_category", "item_count", F.count(F.lit(1)), top=5),
    _by("dim_products_t", "product_category", "item_count", "COUNT(*)", 5),
)
question(
    16,
    lambda e: by(e.dim_sellers, "seller_tier", "seller_count", F.count(F.lit(1))),
    _by("dim_sellers_t", "seller_tier", "seller_count", "COUNT(*)"),
)
question(
    17,
    lambda e: overall(e.dim_sellers, sum_money("total_revenue_brl").alias("total_seller_rev")),
    _one("dim_sellers_t", "total_seller_rev", money_sum("total_revenue_brl")),
)
question(
    18,
    lambda e: overall(e.dim_sellers, mean_money("average_ticket_brl").alias("avg_ticket")),
    _one("dim_sellers_t", "avg_ticket", money_mean("average_ticket_brl")),
)
question(
    19,
    lambda e: overall(e.fct_order_payments.filter("is_credit_card_payment"), rows("cc_count")),
    _count("fct_order_payments_t", "cc_count", "is_credit_card_payment"),
)
question(
    20,
    lambda e: by(e.fct_order_payments, "payment_type", "total_paid", sum_money("payment_amount")),
    _by("fct_order_payments_t", "payment_type", "total_paid", money_sum("payment_amount")),
)
question(
    21,
    lambda e: overall(e.fct_order_payments.filter("is_split_installment"), rows("split_count")),
    _count("fct_order_payments_t", "split_count", "is_split_installment"),
)
question(
    22,
    lambda e: overall(e.fct_orders, mean_money("freight_total_brl").alias("avg_freight")),
    _one("fct_orders_t", "avg_freight", money_mean("freight_total_brl")),
)
question(
    23,
    lambda e: overall(e.fct_orders, sum_money("freight_total_brl").alias("total_freight")),
    _one("fct_orders_t", "total_freight", money_sum("freight_total_brl")),
)
question(
    24,
    lambda e: by(e.fct_orders, "order_status", "count_by_status", F.count(F.lit(1))),
    _by("fct_orders_t", "order_status", "count_by_status", "COUNT(*)"),
)
question(
    25,
    lambda e: overall(e.fct_orders.filter(F.col("customer_review_score") == 5.0), rows("five_star_count")),
    _count("fct_orders_t", "five_star_count", "customer_review_score = 5.0"),
)
question(
    26,
    lambda e: overall(e.fct_orders.filter(F.col("customer_review_score") == 1.0), rows("one_star_count")),
    _count("fct_orders_t", "one_star_count", "customer_review_score = 1.0"),
)
question(
    27,
    lambda e: overall(e.customer_ltv, mean_money("satisfaction_score").alias("avg_csat")),
    _one("customer_ltv_t", "avg_csat", money_mean("satisfaction_score")),
)
question(28, lambda e: overall(e.dim_sellers, rows("total_sellers")), _count("dim_sellers_t", "total_sellers"))
question(
    29,
    lambda e: overall(e.customer_ltv, F.max("total_lifetime_spend_brl").alias("max_spend")),
    _one("customer_ltv_t", "max_spend", "MAX(total_lifetime_spend_brl)"),
)
question(
    30,
    lambda e: overall(e.dim_products.filter(F.col("weight_class") == "lightweight"), rows("lightweight_count")),
    _count("dim_products_t", "lightweight_count", "weight_class = 'lightweight'"),
)
question(
    31,
    lambda e: overall(e.dim_products.filter(F.col("weight_class") == "heavyweight"), rows("heavyweight_count")),
    _count("dim_products_t", "heavyweight_count", "weight_class = 'heavyweight'"),
)
question(
    32,
    lambda e: overall(e.dim_products, mean_money("product_weight_grams").alias("avg_weight")),
    _one("dim_products_t", "avg_weight", money_mean("product_weight_grams")),
)
question(
    33,
    lambda e: by(
        e.mart_geo_performance.withColumn("freight", money("avg_freight_cost_brl") * F.col("total_orders")),
        "customer_city",
        "city_freight",
        sum_money("freight"),
        top=5,
    ),
    _by("mart_geo_t", "customer_city", "city_freight", money_sum("CAST(avg_freight_cost_brl AS DECIMAL(14,2)) * total_orders"), 5),
)
question(
    34,
    lambda e: overall(e.dim_sellers, F.sum("total_items_sold").alias("total_items")),
    _one("dim_sellers_t", "total_items", _int_sum("total_items_sold")),
)
question(
    35,
    lambda e: overall(e.dim_sellers.filter(F.col("seller_tier") == "tier_1_top_seller"), rows("top_sellers_count")),
    _count("dim_sellers_t", "top_sellers_count", "seller_tier = 'tier_1_top_seller'"),
)
question(
    36,
    lambda e: overall(e.dim_products, mean_money("catalog_photo_count").alias("avg_photos")),
    _one("dim_products_t", "avg_photos", money_mean("catalog_photo_count")),
)
question(
    37,
    lambda e: overall(e.dim_customers, F.countDistinct("primary_city").alias("distinct_cities")),
    _one("dim_customers_t", "distinct_cities", "COUNT(DISTINCT primary_city)"),
)
question(
    38,
    lambda e: overall(e.dim_customers, F.countDistinct("primary_state").alias("distinct_states")),
    _one("dim_customers_t", "distinct_states", "COUNT(DISTINCT primary_state)"),
)
question(
    39,
    lambda e: overall(e.fct_orders, sum_money("merchandise_total_brl").alias("merchandise_gmv")),
    _one("fct_orders_t", "merchandise_gmv", money_sum("merchandise_total_brl")),
)
question(
    40,
    lambda e: overall(e.fct_orders, F.sum("total_order_items").alias("total_items_fulfilled")),
    _one("fct_orders_t", "total_items_fulfilled", _int_sum("total_order_items")),
)
question(
    41,
    lambda e: overall(e.dim_products, mean_money("product_volume_cm3").alias("avg_volume")),
    _one("dim_products_t", "avg_volume", money_mean("product_volume_cm3")),
)
question(
    42,
    lambda e: overall(e.fct_orders.filter(F.col("order_status") == "f"), rows("filled_count")),
    _count("fct_orders_t", "filled_count", "order_status = 'f'"),
)
question(
    43,
    lambda e: overall(e.fct_orders, F.max("freight_total_brl").alias("max_freight")),
    _one("fct_orders_t", "max_freight", "MAX(freight_total_brl)"),
)
question(
    44,
    lambda e: overall(e.dim_sellers.filter(F.col("average_ticket_brl") > 0), F.min("average_ticket_brl").alias("min_ticket")),
    _one("dim_sellers_t", "min_ticket", "MIN(average_ticket_brl)", "average_ticket_brl > 0"),
)
question(
    45,
    lambda e: overall(e.customer_ltv.filter(F.col("ltv_segment") == "High Value VIP"), rows("vip_count")),
    _count("customer_ltv_t", "vip_count", "ltv_segment = 'High Value VIP'"),
)


def group_report(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates).orderBy(*order)


register(
    "ans_ltv",
    lambda e: group_report(
        e.customer_ltv,
        ["ltv_segment"],
        [F.col("avg_spend_brl").desc()],
        rows("customer_count"),
        mean_money("total_lifetime_spend_brl").alias("avg_spend_brl"),
        mean_money("satisfaction_score").alias("avg_csat"),
    ),
    f"""SELECT ltv_segment, COUNT(*) AS customer_count, {money_mean('total_lifetime_spend_brl')} AS avg_spend_brl,
    {money_mean('satisfaction_score')} AS avg_csat FROM customer_ltv_t GROUP BY ltv_segment""",
)
register(
    "ans_geo",
    lambda e: e.mart_geo_performance.select(
        "state_code", "customer_city", "total_orders", "regional_gmv_brl", "delay_rate_percentage"
    )
    .orderBy(F.col("regional_gmv_brl").desc(), "customer_city")
    .limit(5),
    """SELECT state_code, customer_city, total_orders, regional_gmv_brl, delay_rate_percentage FROM mart_geo_t
    ORDER BY regional_gmv_brl DESC, customer_city LIMIT 5""",
)
register(
    "ans_reviews",
    lambda e: group_report(
        e.fct_orders.filter(F.col("customer_review_score").isNotNull()),
        ["customer_review_score"],
        [F.col("customer_review_score").desc()],
        rows("order_count"),
        mean_money("grand_total_brl").alias("avg_order_ticket"),
    ),
    f"""SELECT customer_review_score, COUNT(*) AS order_count, {money_mean('grand_total_brl')} AS avg_order_ticket
    FROM fct_orders_t WHERE customer_review_score IS NOT NULL GROUP BY customer_review_score""",
)
register(
    "ans_status",
    lambda e: group_report(
        e.fct_orders,
        ["order_status"],
        [F.col("total_orders").desc()],
        rows("total_orders"),
        sum_money("grand_total_brl").alias("total_gmv_brl"),
    ),
    f"""SELECT order_status, COUNT(*) AS total_orders, {money_sum('grand_total_brl')} AS total_gmv_brl
    FROM fct_orders_t GROUP BY order_status""",
)
