"""The estate's raw tables, bound to the test tables.

Columns the test tables lack (payment kind, weights, review scores, nulls) are derived from
keys by fixed arithmetic, so the SQL oracles can derive the same values.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabellion.operators import estate
from tabellion.sources.tables import read_table

# fixed values: names given to derived categories
PAYMENT_KINDS = [" Credit_Card", "BOLETO", "voucher ", "Debit_Card"]
TRANSLATIONS = {"ECONOMY": "economy_goods", "LARGE": "large_goods", "MEDIUM": "medium_goods", "PROMO": "promo_goods"}
PART_WEIGHTS = (10, 30)
PART_TIERS = (31_000_000, 29_000_000)
LTV_BOUNDS = (4_000_000, 3_000_000)


class Estate:
    """Raw, staging and mart frames over one test folder; every attribute is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
            "n_nationkey", "n_name", "r_name"
        )

    @cached_property
    def raw_customers(self) -> DataFrame:
        customer = self.table("customer")
        return customer.join(self.places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.expr("c_custkey div 2").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.concat(F.lit(" "), "n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
        )

    @cached_property
    def raw_sellers(self) -> DataFrame:
        supplier = self.table("supplier")
        return supplier.join(self.places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("n_name").alias("seller_city"),
            F.lower("r_name").alias("seller_state"),
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        """Orders; the test tables have no delivery time, the last shipping date of the items stands in."""
        placed = F.col("o_orderdate")
        never = F.lit(None).cast("timestamp_ntz")
        shipped = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
        return self.table("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.concat("o_orderstatus", F.lit(" ")).alias("order_status"),
            placed.alias("order_purchase_timestamp"),
            F.when(F.col("o_orderstatus") != "P", placed + F.expr("INTERVAL 1 DAY")).alias("order_approved_at"),
            never.alias("order_delivered_carrier_date"),
            F.col("shipped").cast("timestamp_ntz").alias("order_delivered_customer_date"),
            (placed + F.expr("INTERVAL 90 DAYS")).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (price * F.col("l_tax").cast("decimal(18,2)")).alias("freight_value"),
        )

    @cached_property
    def raw_payments(self) -> DataFrame:
        k = self._event_number
        kinds = F.array(*[F.lit(kind) for kind in PAYMENT_KINDS])
        return self.table("events").filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.element_at(kinds, k % 4 + 1).alias("payment_type"),
            (k % 6 + 1).alias("payment_installments"),
            F.col("value").alias("payment_value"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            key.alias("product_id"),
            F.when(key % 101 != 0, F.col("p_type")).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_brand").alias("product_description_lenght"),
            (size % 7).alias("product_photos_qty"),
            F.when(key % 97 != 0, size).alias("product_weight_g"),
            size.alias("product_length_cm"),
            F.when(key % 89 != 0, size % 13 + 1).alias("product_height_cm"),
            (size % 11 + 1).alias("product_width_cm"),
        )

    @cached_property
    def translation(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(TRANSLATIONS.items()), "product_category_name string, product_category_name_english string"
        )

    @cached_property
    def raw_reviews(self) -> DataFrame:
        turn = F.col("turn").cast("int")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        created = start + F.make_dt_interval(turn)
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
            F.col("conv_id").alias("order_id"),
            (F.length(F.trim("text")) % 5 + 1).alias("review_score"),
            F.col("role").alias("review_comment_title"),
            F.col("text").alias("review_comment_message"),
            created.alias("review_creation_date"),
            (created + F.expr("INTERVAL 2 DAYS")).alias("review_answer_timestamp"),
        )

    @cached_property
    def raw_external_orders(self) -> DataFrame:
        k = self._event_number
        return self.table("events").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            (k % 4).alias("ship_via"),
            F.col("ts").alias("order_date"),
            (F.col("ts") + F.make_dt_interval(k % 10)).alias("shipped_date"),
        )

    @property
    def _event_number(self):
        return F.get_json_object("props", "$.k").cast("int")

    @cached_property
    def stg_customers(self) -> DataFrame:
        return estate.stg_customers(self.raw_customers)

    @cached_property
    def stg_sellers(self) -> DataFrame:
        return estate.stg_sellers(self.raw_sellers)

    @cached_property
    def stg_orders(self) -> DataFrame:
        return estate.stg_orders(self.raw_orders)

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return estate.stg_order_items(self.raw_order_items)

    @cached_property
    def stg_payments(self) -> DataFrame:
        return estate.stg_payments(self.raw_payments)

    @cached_property
    def stg_products(self) -> DataFrame:
        return estate.stg_products(self.raw_products, self.translation)

    @cached_property
    def stg_reviews(self) -> DataFrame:
        return estate.stg_reviews(self.raw_reviews)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return estate.dim_customers(self.stg_customers, self.stg_orders)

    @cached_property
    def dim_products(self) -> DataFrame:
        return estate.dim_products(self.stg_products, PART_WEIGHTS)

    @cached_property
    def dim_sellers(self) -> DataFrame:
        return estate.dim_sellers(self.stg_sellers, self.stg_order_items, PART_TIERS)

    @cached_property
    def fct_order_payments(self) -> DataFrame:
        return estate.fct_order_payments(self.stg_payments)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return estate.fct_orders(self.stg_orders, self.stg_customers, self.stg_order_items, self.stg_reviews)

    @cached_property
    def customer_ltv(self) -> DataFrame:
        return estate.customer_ltv(self.dim_customers, self.fct_orders, LTV_BOUNDS)

    @cached_property
    def mart_geo_performance(self) -> DataFrame:
        return estate.mart_geo_performance(self.fct_orders)

    @cached_property
    def unified_events(self) -> DataFrame:
        marketplace = self.stg_orders.select(
            F.col("order_id").alias("event_id"),
            F.col("customer_id").alias("party_id"),
            F.col("purchase_timestamp").alias("event_timestamp"),
            F.col("approved_at").alias("fulfillment_timestamp"),
        )
        external = self.raw_external_orders.select(
            F.col("order_id").alias("event_id"),
            F.col("customer_id").alias("party_id"),
            F.col("order_date").alias("event_timestamp"),
            F.col("shipped_date").alias("fulfillment_timestamp"),
        )
        return estate.unified_events(marketplace, external)

    @cached_property
    def federated_shipments(self) -> DataFrame:
        return estate.federated_shipments(self.raw_external_orders, self.stg_orders, self.stg_order_items)
