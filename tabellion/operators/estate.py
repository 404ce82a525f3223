"""Staging models, dimensions, facts and marts of the estate.

Every model is a function from DataFrames to a DataFrame; amounts are added as decimals and
returned as doubles, so results are the same whatever order the rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.columns import first_match, mean_money, money, ratio, sum_money
from tabellion.functions.ordered import OrderedGroups

# fixed values: segment thresholds of the marts
REPEAT_ORDERS = 1
SELLER_TIERS = (10000, 2000)
LTV_SEGMENTS = (500, 150)
WEIGHT_CLASSES = (500, 2000)
DEFAULT_RATING = 5.0


def _trim_lower(name: str) -> Column:
    return F.lower(F.trim(name))


def _timestamp(name: str) -> Column:
    return F.col(name).try_cast("timestamp_ntz")


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").cast("string").alias("zip_code_prefix"),
        _trim_lower("customer_city").alias("customer_city"),
        F.upper(F.trim("customer_state")).alias("customer_state"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        F.col("seller_zip_code_prefix").cast("string").alias("zip_code_prefix"),
        _trim_lower("seller_city").alias("seller_city"),
        F.upper(F.trim("seller_state")).alias("seller_state"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    renamed = {
        "purchase_timestamp": "order_purchase_timestamp",
        "approved_at": "order_approved_at",
        "delivered_carrier_at": "order_delivered_carrier_date",
        "delivered_customer_at": "order_delivered_customer_date",
        "estimated_delivery_at": "order_estimated_delivery_date",
    }
    return raw.select(
        "order_id",
        "customer_id",
        _trim_lower("order_status").alias("order_status"),
        *[_timestamp(source).alias(name) for name, source in renamed.items()],
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        "product_id",
        "seller_id",
        _timestamp("shipping_limit_date").alias("shipping_limit_timestamp"),
        F.col("price").cast("double").alias("item_price"),
        F.col("freight_value").cast("double").alias("freight_value"),
    )


def stg_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        F.col("payment_sequential").cast("int").alias("payment_sequential"),
        _trim_lower("payment_type").alias("payment_type"),
        F.col("payment_installments").cast("int").alias("payment_installments"),
        F.col("payment_value").cast("double").alias("payment_amount"),
    )


def stg_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    sides = [F.coalesce(F.col(f"product_{s}_cm"), F.lit(0)) for s in ("length", "height", "width")]
    names = translation.select("product_category_name", "product_category_name_english")
    return raw.join(names, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("category_portuguese"),
        F.coalesce("product_category_name_english", "product_category_name", F.lit("unspecified")).alias("category_english"),
        F.col("product_name_lenght").cast("int").alias("name_char_length"),
        F.col("product_description_lenght").cast("int").alias("description_char_length"),
        F.col("product_photos_qty").cast("int").alias("photos_count"),
        F.col("product_weight_g").cast("double").alias("weight_g"),
        F.col("product_length_cm").cast("double").alias("length_cm"),
        F.col("product_height_cm").cast("double").alias("height_cm"),
        F.col("product_width_cm").cast("double").alias("width_cm"),
        (sides[0] * sides[1] * sides[2]).cast("double").alias("volume_cm3"),
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        F.col("review_score").cast("int").alias("review_score"),
        F.trim("review_comment_title").alias("review_title"),
        F.trim("review_comment_message").alias("review_comment"),
        _timestamp("review_creation_date").alias("review_created_at"),
        _timestamp("review_answer_timestamp").alias("review_answered_at"),
    )


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per person over all of their accounts; people without orders stay.

    Attributes and order activity are reduced to the person separately, so the order rows
    carry only keys and times through their shuffles and the wide text minimum is taken over
    accounts, not over orders.
    """
    people = customers.groupBy("customer_unique_id").agg(
        F.min("customer_city").alias("primary_city"),
        F.min("customer_state").alias("primary_state"),
        F.min("zip_code_prefix").alias("primary_zip"),
    )
    accounts = customers.select("customer_id", F.col("customer_unique_id").alias("_person"))
    activity = (
        orders.select("customer_id", "order_id", "purchase_timestamp")
        .join(accounts, "customer_id")
        .groupBy("_person")
        .agg(
            F.countDistinct("order_id").alias("_orders"),
            F.min("purchase_timestamp").alias("first_order_date"),
            F.max("purchase_timestamp").alias("latest_order_date"),
        )
    )
    placed = F.coalesce("_orders", F.lit(0))
    return people.join(activity, F.col("customer_unique_id").eqNullSafe(F.col("_person")), "left").select(
        "customer_unique_id",
        "primary_city",
        "primary_state",
        "primary_zip",
        placed.alias("total_orders_placed"),
        "first_order_date",
        "latest_order_date",
        F.when(placed > REPEAT_ORDERS, "repeat_buyer").otherwise("single_buyer").alias("buyer_type"),
    )


def dim_products(products: DataFrame, classes: tuple[float, float] = WEIGHT_CLASSES) -> DataFrame:
    weight = F.col("weight_g")
    light, medium = classes
    return products.select(
        "product_id",
        F.col("category_english").alias("product_category"),
        F.col("category_portuguese").alias("raw_category_name"),
        weight.alias("product_weight_grams"),
        F.col("volume_cm3").alias("product_volume_cm3"),
        F.col("photos_count").alias("catalog_photo_count"),
        first_match(
            [(weight.isNull(), "unknown"), (weight < light, "lightweight"), (weight < medium, "medium_weight")],
            "heavyweight",
        ).alias("weight_class"),
    )


def dim_sellers(sellers: DataFrame, items: DataFrame, tiers: tuple[float, float] = SELLER_TIERS) -> DataFrame:
    """Sales are added up per seller before the join, so the sellers join one row each."""
    sales = items.groupBy("seller_id").agg(
        F.count("order_id").alias("sold"),
        F.sum(money("item_price")).alias("revenue"),
        mean_money("item_price").alias("ticket"),
    )
    people = sellers.groupBy("seller_id").agg(
        F.min("seller_city").alias("seller_city"),
        F.min("seller_state").alias("seller_state"),
        F.min("zip_code_prefix").alias("seller_zip"),
    )
    revenue = F.coalesce("revenue", F.lit(0)).cast("double")
    top, growth = tiers
    return people.join(sales, "seller_id", "left").select(
        "seller_id",
        "seller_city",
        "seller_state",
        "seller_zip",
        F.coalesce("sold", F.lit(0)).alias("total_items_sold"),
        F.round(revenue, 2).alias("total_revenue_brl"),
        F.coalesce("ticket", F.lit(0.0)).alias("average_ticket_brl"),
        first_match(
            [(revenue > top, "tier_1_top_seller"), (revenue > growth, "tier_2_growth_seller")],
            "tier_3_standard_seller",
        ).alias("seller_tier"),
    )


def fct_order_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        money("payment_amount").cast("double").alias("payment_amount"),
        F.coalesce(F.col("payment_type") == "credit_card", F.lit(False)).alias("is_credit_card_payment"),
        F.coalesce(F.col("payment_installments") > 1, F.lit(False)).alias("is_split_installment"),
    )


def fct_orders(orders: DataFrame, customers: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Order-grain fact: items and reviews are reduced to the order before they are joined.

    An order without a delivery time is not delivered, so it is not late either.
    """
    per_order = items.groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        F.countDistinct("product_id").alias("n_products"),
        F.sum(F.col("item_price").cast("decimal(18,4)")).alias("merchandise"),
        F.sum(F.col("freight_value").cast("decimal(18,4)")).alias("freight"),
    )
    rating = reviews.groupBy("order_id").agg(
        F.round(F.sum("review_score").cast("decimal(20,0)") / F.count("review_score"), 1)
        .cast("double")
        .alias("customer_review_score")
    )
    who = customers.select("customer_id", "customer_unique_id", "customer_state", "customer_city")
    none = F.lit(0).cast("decimal(18,4)")
    merchandise = F.coalesce("merchandise", none)
    freight = F.coalesce("freight", none)
    delivered = F.col("delivered_customer_at")
    return (
        orders.join(per_order, "order_id", "left")
        .join(rating, "order_id", "left")
        .join(who, "customer_id", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_unique_id",
            "customer_state",
            "customer_city",
            "order_status",
            "purchase_timestamp",
            "approved_at",
            "delivered_customer_at",
            "estimated_delivery_at",
            F.coalesce("n_items", F.lit(0)).alias("total_order_items"),
            F.coalesce("n_products", F.lit(0)).alias("distinct_products_count"),
            F.round(merchandise, 2).cast("double").alias("merchandise_total_brl"),
            F.round(freight, 2).cast("double").alias("freight_total_brl"),
            F.round(merchandise + freight, 2).cast("double").alias("grand_total_brl"),
            "customer_review_score",
            F.coalesce(delivered > F.col("estimated_delivery_at"), F.lit(False)).alias("is_delayed_delivery"),
        )
    )


def customer_ltv(people: DataFrame, facts: DataFrame, segments: tuple[float, float] = LTV_SEGMENTS) -> DataFrame:
    spend = (
        facts.filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            sum_money("grand_total_brl").alias("spent"),
            mean_money("grand_total_brl").alias("ticket"),
            F.coalesce(mean_money("customer_review_score"), F.lit(DEFAULT_RATING)).alias("satisfaction_score"),
        )
    )
    spent = F.coalesce("spent", F.lit(0.0))
    vip, core = segments
    return people.join(spend, "customer_unique_id", "left").select(
        "customer_unique_id",
        "primary_city",
        "primary_state",
        "primary_zip",
        "total_orders_placed",
        spent.alias("total_lifetime_spend_brl"),
        F.coalesce("ticket", F.lit(0.0)).alias("avg_order_ticket_brl"),
        "satisfaction_score",
        "first_order_date",
        "latest_order_date",
        first_match([(spent >= vip, "High Value VIP"), (spent >= core, "Mid Tier Core")], "Low Tier Standard").alias(
            "ltv_segment"
        ),
    )


def mart_geo_performance(facts: DataFrame) -> DataFrame:
    late = F.count_if("is_delayed_delivery")
    orders = F.count("order_id")
    return (
        facts.filter(F.col("customer_state").isNotNull())
        .groupBy(F.col("customer_state").alias("state_code"), "customer_city")
        .agg(
            orders.alias("total_orders"),
            sum_money("grand_total_brl").alias("regional_gmv_brl"),
            mean_money("freight_total_brl").alias("avg_freight_cost_brl"),
            mean_money("customer_review_score").alias("avg_regional_satisfaction"),
            late.alias("delayed_orders_count"),
            ratio(late, orders, 2, scale=100).alias("delay_rate_percentage"),
        )
    )


def unified_events(marketplace: DataFrame, external: DataFrame, names: tuple[str, str] = ("OLIST", "NORTHWIND"), **limits: int) -> DataFrame:
    """Deliveries of two platforms with their recency inside the party and the platform.

    Both inputs need event_id, party_id, event_timestamp and fulfillment_timestamp.
    """
    columns = ["event_id", "party_id", "event_timestamp", "fulfillment_timestamp"]
    both = (
        marketplace.select(*columns, F.lit(names[0]).alias("platform_source"))
        .unionByName(external.select(*columns, F.lit(names[1]).alias("platform_source")))
    )
    per_party = OrderedGroups(both, ["platform_source", "party_id"], ["-event_timestamp", "-event_id"], **limits)
    numbered = per_party.row_number("customer_seq_num")
    per_platform = OrderedGroups(numbered, ["platform_source"], ["-event_timestamp", "-event_id"], **limits)
    return per_platform.dense_rank("recency_dense_rank")


def federated_shipments(external: DataFrame, orders: DataFrame, items: DataFrame, **limits: int) -> DataFrame:
    """External orders matched to marketplace orders, with items per carrier code.

    The item count per order is aggregated once and joined, instead of a lookup per row.
    """
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"))
    matched = external.join(orders.select("order_id", "order_status"), "order_id").join(per_order, "order_id", "left")
    ranked = OrderedGroups(matched, ["customer_id"], ["order_date", "order_id"], **limits).row_number("order_sequence_rank")
    carrier = F.nullif(F.col("ship_via"), F.lit(0)).cast("double")
    return ranked.select(
        F.col("order_id").alias("external_order_id"),
        F.col("customer_id").alias("external_customer_id"),
        F.col("order_status").alias("marketplace_status"),
        "order_sequence_rank",
        (F.coalesce("n_items", F.lit(0)).cast("double") * 100.0 / carrier).alias("carrier_item_ratio"),
    )
