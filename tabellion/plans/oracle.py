"""Common table expressions the SQL oracles are assembled from.

Each entry is plain SQL over the test tables or over earlier entries; ``with_tables`` prefixes
a query with the entries it mentions, directly or through others; a query that brings its own
WITH list is left alone.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    TABLES[name] = sql


def with_tables(query: str, recursive: bool = False) -> str:
    if query.lstrip().startswith("WITH"):
        return query
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if re.search(rf"\b{name}\b", TABLES[name]):
                    raise ValueError(f"{name} mentions itself")
                visit(TABLES[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    # computed once however often they are read
    kept = {"estate_profile", "ruled", "reconciled_t"}
    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in kept else ''}({TABLES[name]})" for name in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{query}"


def money_sum(expression: str) -> str:
    return f"CAST(SUM(CAST({expression} AS DECIMAL(18,2))) AS DOUBLE)"


def money_mean(expression: str) -> str:
    """Average to two digits, half up, in integer arithmetic on cents."""
    cents = f"SUM(CAST(CAST({expression} AS DECIMAL(18,2)) * 100 AS BIGINT))"
    n = f"COUNT({expression})"
    return f"(SIGN({cents}) * CAST((2 * ABS({cents}) + {n}) // NULLIF(2 * {n}, 0) AS DOUBLE) / 100)"


def half_up(part: str, whole: str, digits: int, scale: int = 1) -> str:
    """``scale * part / whole`` of non-negative integers, rounded half up in integer arithmetic."""
    unit = 10**digits
    top = f"CAST({part} AS HUGEINT) * {scale * unit}"
    return f"(CAST((2 * {top} + ({whole})) // NULLIF(2 * ({whole}), 0) AS DOUBLE) / {unit})"


define("places", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
define(
    "stg_customers_t",
    """SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id,
    CAST(c_nationkey AS VARCHAR) AS zip_code_prefix, lower(trim(n_name)) AS customer_city,
    upper(trim(r_name)) AS customer_state
    FROM customer LEFT JOIN places ON c_nationkey = n_nationkey""",
)
define(
    "stg_sellers_t",
    """SELECT s_suppkey AS seller_id, CAST(s_nationkey AS VARCHAR) AS zip_code_prefix,
    lower(trim(n_name)) AS seller_city, upper(trim(r_name)) AS seller_state
    FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey""",
)
define(
    "stg_orders_t",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, lower(trim(o_orderstatus)) AS order_status,
    o_orderdate AS purchase_timestamp,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS approved_at,
    CAST(NULL AS TIMESTAMP) AS delivered_carrier_at, CAST(shipped AS TIMESTAMP) AS delivered_customer_at,
    o_orderdate + INTERVAL 90 DAY AS estimated_delivery_at
    FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
define(
    "stg_order_items_t",
    """SELECT l_orderkey AS order_id, CAST(l_linenumber AS INTEGER) AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id, l_shipdate AS shipping_limit_timestamp, l_extendedprice AS item_price,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS freight_value
    FROM lineitem""",
)
define(
    "event_numbers",
    """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
define(
    "stg_payments_t",
    """SELECT event_id AS order_id, CAST(1 AS INTEGER) AS payment_sequential,
    CASE k % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
    CAST(k % 6 + 1 AS INTEGER) AS payment_installments, value AS payment_amount
    FROM event_numbers WHERE event_type = 'purchase'""",
)
define(
    "stg_products_t",
    """SELECT p_partkey AS product_id, category AS category_portuguese,
    COALESCE(CASE category WHEN 'ECONOMY' THEN 'economy_goods' WHEN 'LARGE' THEN 'large_goods'
      WHEN 'MEDIUM' THEN 'medium_goods' WHEN 'PROMO' THEN 'promo_goods' END, category, 'unspecified') AS category_english,
    CAST(length(p_name) AS INTEGER) AS name_char_length, CAST(length(p_brand) AS INTEGER) AS description_char_length,
    CAST(p_size % 7 AS INTEGER) AS photos_count,
    CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_size AS DOUBLE) END AS weight_g,
    CAST(p_size AS DOUBLE) AS length_cm, CASE WHEN p_partkey % 89 <> 0 THEN CAST(p_size % 13 + 1 AS DOUBLE) END AS height_cm,
    CAST(p_size % 11 + 1 AS DOUBLE) AS width_cm,
    CAST(p_size * CASE WHEN p_partkey % 89 <> 0 THEN p_size % 13 + 1 ELSE 0 END * (p_size % 11 + 1) AS DOUBLE) AS volume_cm3
    FROM (SELECT *, CASE WHEN p_partkey % 101 <> 0 THEN p_type END AS category FROM part)""",
)
define(
    "stg_reviews_t",
    """SELECT conv_id * 1000 + turn AS review_id, conv_id AS order_id,
    CAST(length(trim(text)) % 5 + 1 AS INTEGER) AS review_score, trim(role) AS review_title, trim(text) AS review_comment,
    TIMESTAMP '2024-01-01' + to_days(CAST(turn AS INTEGER)) AS review_created_at,
    TIMESTAMP '2024-01-03' + to_days(CAST(turn AS INTEGER)) AS review_answered_at
    FROM conversations""",
)
define(
    "dim_customers_t",
    """SELECT customer_unique_id, MIN(customer_city) AS primary_city, MIN(customer_state) AS primary_state,
    MIN(zip_code_prefix) AS primary_zip, COUNT(DISTINCT order_id) AS total_orders_placed,
    MIN(purchase_timestamp) AS first_order_date, MAX(purchase_timestamp) AS latest_order_date,
    CASE WHEN COUNT(DISTINCT order_id) > 1 THEN 'repeat_buyer' ELSE 'single_buyer' END AS buyer_type
    FROM stg_customers_t LEFT JOIN stg_orders_t USING (customer_id) GROUP BY customer_unique_id""",
)
define(
    "dim_products_t",
    """SELECT product_id, category_english AS product_category, category_portuguese AS raw_category_name,
    weight_g AS product_weight_grams, volume_cm3 AS product_volume_cm3, photos_count AS catalog_photo_count,
    CASE WHEN weight_g IS NULL THEN 'unknown' WHEN weight_g < 10 THEN 'lightweight'
      WHEN weight_g < 30 THEN 'medium_weight' ELSE 'heavyweight' END AS weight_class FROM stg_products_t""",
)
define(
    "dim_sellers_t",
    f"""SELECT seller_id, MIN(seller_city) AS seller_city, MIN(seller_state) AS seller_state,
    MIN(zip_code_prefix) AS seller_zip, COUNT(order_id) AS total_items_sold,
    COALESCE({money_sum('item_price')}, 0.0) AS total_revenue_brl,
    COALESCE({money_mean('item_price')}, 0.0) AS average_ticket_brl,
    CASE WHEN COALESCE({money_sum('item_price')}, 0.0) > 31000000 THEN 'tier_1_top_seller'
      WHEN COALESCE({money_sum('item_price')}, 0.0) > 29000000 THEN 'tier_2_growth_seller'
      ELSE 'tier_3_standard_seller' END AS seller_tier
    FROM stg_sellers_t LEFT JOIN stg_order_items_t USING (seller_id) GROUP BY seller_id""",
)
define(
    "fct_order_payments_t",
    """SELECT order_id, payment_sequential, payment_type, payment_installments,
    CAST(CAST(payment_amount AS DECIMAL(18,2)) AS DOUBLE) AS payment_amount,
    payment_type = 'credit_card' AS is_credit_card_payment, payment_installments > 1 AS is_split_installment
    FROM stg_payments_t""",
)
define(
    "order_item_sums",
    """SELECT order_id, COUNT(order_item_id) AS n_items, COUNT(DISTINCT product_id) AS n_products,
    SUM(CAST(item_price AS DECIMAL(18,4))) AS merchandise, SUM(CAST(freight_value AS DECIMAL(18,4))) AS freight
    FROM stg_order_items_t GROUP BY order_id""",
)
define(
    "order_ratings",
    f"""SELECT order_id, {half_up('SUM(review_score)', 'COUNT(review_score)', 1)} AS customer_review_score
    FROM stg_reviews_t GROUP BY order_id""",
)
define(
    "fct_orders_t",
    """SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_state, c.customer_city, o.order_status,
    o.purchase_timestamp, o.approved_at, o.delivered_customer_at, o.estimated_delivery_at,
    COALESCE(i.n_items, 0) AS total_order_items, COALESCE(i.n_products, 0) AS distinct_products_count,
    CAST(ROUND(COALESCE(i.merchandise, 0.0000), 2) AS DOUBLE) AS merchandise_total_brl,
    CAST(ROUND(COALESCE(i.freight, 0.0000), 2) AS DOUBLE) AS freight_total_brl,
    CAST(ROUND(COALESCE(i.merchandise, 0.0000) + COALESCE(i.freight, 0.0000), 2) AS DOUBLE) AS grand_total_brl,
    r.customer_review_score, COALESCE(o.delivered_customer_at > o.estimated_delivery_at, FALSE) AS is_delayed_delivery
    FROM stg_orders_t o LEFT JOIN stg_customers_t c ON o.customer_id = c.customer_id
    LEFT JOIN order_item_sums i ON o.order_id = i.order_id LEFT JOIN order_ratings r ON o.order_id = r.order_id""",
)
define(
    "person_spend",
    f"""SELECT customer_unique_id, {money_sum('grand_total_brl')} AS spent, {money_mean('grand_total_brl')} AS ticket,
    COALESCE({money_mean('customer_review_score')}, 5.0) AS satisfaction_score
    FROM fct_orders_t WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
)
define(
    "customer_ltv_t",
    """SELECT customer_unique_id, primary_city, primary_state, primary_zip, total_orders_placed,
    COALESCE(spent, 0.0) AS total_lifetime_spend_brl, COALESCE(ticket, 0.0) AS avg_order_ticket_brl, satisfaction_score,
    first_order_date, latest_order_date,
    CASE WHEN COALESCE(spent, 0) >= 4000000 THEN 'High Value VIP' WHEN COALESCE(spent, 0) >= 3000000 THEN 'Mid Tier Core'
      ELSE 'Low Tier Standard' END AS ltv_segment
    FROM dim_customers_t LEFT JOIN person_spend USING (customer_unique_id)""",
)
define(
    "mart_geo_t",
    f"""SELECT customer_state AS state_code, customer_city, COUNT(order_id) AS total_orders,
    {money_sum('grand_total_brl')} AS regional_gmv_brl, {money_mean('freight_total_brl')} AS avg_freight_cost_brl,
    {money_mean('customer_review_score')} AS avg_regional_satisfaction,
    CAST(SUM(CASE WHEN is_delayed_delivery THEN 1 ELSE 0 END) AS BIGINT) AS delayed_orders_count,
    {half_up('SUM(CASE WHEN is_delayed_delivery THEN 1 ELSE 0 END)', 'COUNT(order_id)', 2, 100)} AS delay_rate_percentage
    FROM fct_orders_t WHERE customer_state IS NOT NULL GROUP BY ALL""",
)
define(
    "external_orders_t",
    """SELECT event_id AS order_id, user_id AS customer_id, k % 4 AS ship_via, ts AS order_date,
    ts + to_days(k % 10) AS shipped_date FROM event_numbers""",
)
