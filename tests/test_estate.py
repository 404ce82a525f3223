import datetime as dt

from tabellion.operators import estate


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_orders_without_items_or_reviews_stay(spark):
    orders = spark.createDataFrame(
        [(1, 10, "f", ts(1), None, None, None, ts(3)), (2, 11, "o", ts(2), None, None, ts(9), ts(4)), (3, 99, "o", ts(2), None, None, None, None)],
        "order_id int, customer_id int, order_status string, purchase_timestamp timestamp_ntz, approved_at timestamp_ntz, "
        "delivered_carrier_at timestamp_ntz, delivered_customer_at timestamp_ntz, estimated_delivery_at timestamp_ntz",
    )
    customers = spark.createDataFrame([(10, 1, "9000", "a", "S"), (11, 1, "9001", "b", "S")], "customer_id int, customer_unique_id int, zip_code_prefix string, customer_city string, customer_state string")
    items = spark.createDataFrame(
        [(1, 1, 5, 7, ts(5), 1.005, 0.1), (1, 2, 5, 7, ts(2), 2.0, 0.0), (1, 3, 6, 7, ts(1), 3.0, None)],
        "order_id int, order_item_id int, product_id int, seller_id int, shipping_limit_timestamp timestamp_ntz, item_price double, freight_value double",
    )
    reviews = spark.createDataFrame([(1, 1, 4), (2, 1, 5), (3, 1, None)], "review_id int, order_id int, review_score int")
    rows = {r.order_id: r for r in estate.fct_orders(orders, customers, items, reviews).collect()}
    assert (rows[1].total_order_items, rows[1].distinct_products_count) == (3, 2)
    assert rows[1].merchandise_total_brl == 6.01 and rows[1].grand_total_brl == 6.11
    # not delivered: its items were due later than the order, which says nothing about a delivery
    assert rows[1].customer_review_score == 4.5 and not rows[1].is_delayed_delivery and rows[1].delivered_customer_at is None
    assert rows[2].grand_total_brl == 0.0 and rows[2].customer_review_score is None and rows[2].is_delayed_delivery
    assert rows[3].customer_unique_id is None and not rows[3].is_delayed_delivery

    people = estate.dim_customers(customers, orders)
    ltv = {r.customer_unique_id: r for r in estate.customer_ltv(people, estate.fct_orders(orders, customers, items, reviews)).collect()}
    assert ltv[1].total_orders_placed == 2 and ltv[1].ltv_segment == "Low Tier Standard" and ltv[1].satisfaction_score == 4.5


def test_unknown_weight_and_tiers(spark):
    products = spark.createDataFrame(
        [(1, None), (2, 499.0), (3, 1999.0), (4, 2000.0)], "product_id int, weight_g double"
    ).selectExpr("*", "'c' category_english", "'c' category_portuguese", "1.0D volume_cm3", "1 photos_count")
    classes = {r.product_id: r.weight_class for r in estate.dim_products(products).collect()}
    assert classes == {1: "unknown", 2: "lightweight", 3: "medium_weight", 4: "heavyweight"}


def test_platform_recency_is_the_same_for_large_groups(spark):
    rows = [(i, i % 3, ts(1 + i % 9), ts(10)) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id int, party_id int, event_timestamp timestamp_ntz, fulfillment_timestamp timestamp_ntz")
    plain = estate.unified_events(frame, frame)
    sliced = estate.unified_events(frame, frame, max_group_rows=7)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.select(plain.columns).collect()))
    assert plain.agg({"recency_dense_rank": "max"}).first()[0] == 9
