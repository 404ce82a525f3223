"""Staging models, dimensions, facts and marts."""

from __future__ import annotations

from tabellion.plans.registry import register

MODELS = {
    "stg_customers": "stg_customers_t",
    "stg_sellers": "stg_sellers_t",
    "stg_orders": "stg_orders_t",
    "stg_order_items": "stg_order_items_t",
    "stg_payments": "stg_payments_t",
    "stg_products": "stg_products_t",
    "stg_reviews": "stg_reviews_t",
    "dim_customers": "dim_customers_t",
    "dim_products": "dim_products_t",
    "dim_sellers": "dim_sellers_t",
    "fct_order_payments": "fct_order_payments_t",
    "fct_orders": "fct_orders_t",
    "customer_ltv": "customer_ltv_t",
    "mart_geo_performance": "mart_geo_t",
}

for model, table in MODELS.items():
    columns = "* EXCLUDE (review_created_at, review_answered_at), review_created_at, review_answered_at" if model == "stg_reviews" else "*"
    register(model, lambda e, model=model: getattr(e, model), f"SELECT {columns} FROM {table}")

register(
    "unified_events",
    lambda e: e.unified_events,
    """SELECT event_id, party_id, event_timestamp, fulfillment_timestamp, platform_source,
    ROW_NUMBER() OVER (PARTITION BY platform_source, party_id ORDER BY event_timestamp DESC, event_id DESC) AS customer_seq_num,
    DENSE_RANK() OVER (PARTITION BY platform_source ORDER BY event_timestamp DESC) AS recency_dense_rank
    FROM (SELECT order_id AS event_id, customer_id AS party_id, purchase_timestamp AS event_timestamp,
            approved_at AS fulfillment_timestamp, 'OLIST' AS platform_source FROM stg_orders_t
          UNION ALL
          SELECT order_id, customer_id, order_date, shipped_date, 'NORTHWIND' FROM external_orders_t)""",
)

register(
    "federated_shipments",
    lambda e: e.federated_shipments,
    """SELECT x.order_id AS external_order_id, x.customer_id AS external_customer_id, o.order_status AS marketplace_status,
    ROW_NUMBER() OVER (PARTITION BY x.customer_id ORDER BY x.order_date, x.order_id) AS order_sequence_rank,
    100.0::DOUBLE * (SELECT COUNT(*) FROM stg_order_items_t i WHERE i.order_id = x.order_id) / NULLIF(x.ship_via, 0) AS carrier_item_ratio
    FROM external_orders_t x JOIN stg_orders_t o ON x.order_id = o.order_id""",
)
