"""Sources and sinks, schema inventory, versioned assets, labels, search, context and masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import joined
from tabellion.operators import catalog, estate, search
from tabellion.plans.binding import LTV_BOUNDS, PART_TIERS, PART_WEIGHTS, Estate
from tabellion.plans.estate_queries import MODELS
from tabellion.plans.oracle import define, half_up
from tabellion.plans.registry import query, register
from tabellion.plans.schemas import SCHEMAS
from tabellion.session import scratch_path
from tabellion.sources import tables as sources

# --- sources and sinks ---------------------------------------------------------------------

CUSTOMER_CSV = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(
    "src_csv_roundtrip",
    "SELECT * REPLACE (CASE WHEN c_custkey % 97 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 89 <> 0 THEN c_acctbal END AS c_acctbal) FROM customer",
)
def src_csv_roundtrip(e: Estate) -> DataFrame:
    key = F.col("c_custkey")
    holed = e.table("customer").withColumns(
        {"c_name": F.when(key % 97 != 0, F.col("c_name")), "c_acctbal": F.when(key % 89 != 0, F.col("c_acctbal"))}
    )
    path = scratch_path(e.spark, "customer_csv")
    sources.write_csv(holed, path)
    return sources.read_csv(e.spark, path, CUSTOMER_CSV)


register("sample_first_n", lambda e: sources.first_rows(e.table("orders"), ["o_orderkey"], 8000), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8000")
register(
    "sample_first_n_per_source",
    lambda e: sources.first_rows_per(e.table("events"), ["event_type"], ["ts", "event_id"], 500),
    "SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 500",
)
register(
    "latest_by_key",
    lambda e: sources.latest_per_key(e.table("events"), ["user_id"], ["ts", "event_id"]),
    "SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)


@query("estate_materialised", "SELECT * FROM mart_geo_t")
def estate_materialised(e: Estate) -> DataFrame:
    """The model list stored table by table in dependency order; the last mart is read back."""
    raw = {n: getattr(e, n) for n in ("raw_customers", "raw_orders", "raw_order_items", "raw_reviews")}
    models = {
        "mart_geo_performance": (["fct_orders"], estate.mart_geo_performance),
        "fct_orders": (["stg_orders", "stg_customers", "stg_order_items", "stg_reviews"], estate.fct_orders),
        "stg_customers": (["raw_customers"], estate.stg_customers),
        "stg_orders": (["raw_orders"], estate.stg_orders),
        "stg_order_items": (["raw_order_items"], estate.stg_order_items),
        "stg_reviews": (["raw_reviews"], estate.stg_reviews),
    }
    return sources.materialise(e.spark, models, raw, scratch_path(e.spark, "estate"))["mart_geo_performance"]


@query(
    "estate_models_materialised",
    "\nUNION ALL\n".join(f"SELECT '{model}' AS model, COUNT(*) AS row_count FROM {table}" for model, table in MODELS.items()),
)
def estate_models_materialised(e: Estate) -> DataFrame:
    """All models stored in dependency order; the rows of each stored table."""
    names = ["raw_customers", "raw_sellers", "raw_orders", "raw_order_items", "raw_payments", "raw_products", "raw_reviews", "translation"]
    models = {
        "mart_geo_performance": (["fct_orders"], estate.mart_geo_performance),
        "customer_ltv": (["dim_customers", "fct_orders"], lambda people, facts: estate.customer_ltv(people, facts, LTV_BOUNDS)),
        "fct_orders": (["stg_orders", "stg_customers", "stg_order_items", "stg_reviews"], estate.fct_orders),
        "fct_order_payments": (["stg_payments"], estate.fct_order_payments),
        "dim_customers": (["stg_customers", "stg_orders"], estate.dim_customers),
        "dim_products": (["stg_products"], lambda products: estate.dim_products(products, PART_WEIGHTS)),
        "dim_sellers": (["stg_sellers", "stg_order_items"], lambda sellers, items: estate.dim_sellers(sellers, items, PART_TIERS)),
        "stg_products": (["raw_products", "translation"], estate.stg_products),
        **{f"stg_{n}": ([f"raw_{n}"], getattr(estate, f"stg_{n}")) for n in ("customers", "sellers", "orders", "order_items", "payments", "reviews")},
    }
    built = sources.materialise(e.spark, models, {n: getattr(e, n) for n in names}, scratch_path(e.spark, "estate"))
    counted = [built[m].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(m).alias("model"), "row_count") for m in MODELS]
    return reduce(DataFrame.unionAll, counted)


# --- schema inventory ----------------------------------------------------------------------

CONSUMERS = {
    "dashboard.executive_revenue": ("Executive Revenue Overview", "orders"),
    "dashboard.customer_retention": ("Customer Retention & LTV Hub", "customer"),
    "dashboard.logistics_control_tower": ("Logistics & SLA Tower", "lineitem"),
}
CERTIFIED = ("orders", "customer")


def inventory(e: Estate) -> DataFrame:
    return catalog.schema_inventory({t: e.table(t) for t in SCHEMAS}, certified=CERTIFIED, consumers=CONSUMERS)


def _inventory_rows() -> str:
    def text(value: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"

    def row(asset, parent, kind, name, display, data_type, owner, status, count, nulls) -> str:
        cells = [text(v) for v in (asset, parent, kind, name, display, data_type, owner, status)]
        names = ["asset_id", "parent_id", "asset_type", "name", "display_name", "data_type", "owner", "certification_status"]
        listed = ", ".join(f"{c} AS {n}" for c, n in zip(cells, names, strict=True))
        return f"SELECT {listed}, {count} AS row_count, {nulls} AS null_percentage"

    none = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)"
    rows = [row("estate", None, "DATABASE", "estate", None, None, None, "CERTIFIED", *none)]
    for table, columns in SCHEMAS.items():
        status = "CERTIFIED" if table in CERTIFIED else "DRAFT"
        owner = "Analytics Engineering" if table in CERTIFIED else "Data Engineering"
        table_id = f"estate.public.{table}"
        title = table[0].upper() + table[1:]
        rows.append(row(table_id, "estate", "TABLE", table, title, None, owner, status, "COUNT(*)", none[1]) + f" FROM {table}")
        for column, kind in columns:
            rate = half_up(f"(COUNT(*) - COUNT({column}))", "COUNT(*)", 2, 100)
            rows.append(row(f"{table_id}.{column}", table_id, "COLUMN", column, None, kind, None, status, "COUNT(*)", rate) + f" FROM {table}")
    for asset, (name, _) in CONSUMERS.items():
        rows.append(row(asset, None, "DASHBOARD", name, name, None, "BI Analytics Team", "CERTIFIED", *none))
    return "\nUNION ALL\n".join(rows)


define("inventory_t", _inventory_rows())
register("schema_inventory", inventory, "SELECT * FROM inventory_t")


@query("lakehouse_roundtrip", "SELECT * FROM inventory_t")
def lakehouse_roundtrip(e: Estate) -> DataFrame:
    """Catalog tables exported as Parquet, assets partitioned by type, and read back."""
    path = scratch_path(e.spark, "lakehouse")
    assets = inventory(e)
    sources.write_lakehouse({"assets": assets, "tags": label_tags(e)}, path, {"assets": ["asset_type"]})
    return sources.open_lakehouse(e.spark, path, ["assets"])["assets"].select(*assets.columns)


@query(
    "lakehouse_adhoc_sql",
    "SELECT asset_type, certification_status, COUNT(*) AS assets, CAST(SUM(row_count) AS BIGINT) AS scanned_rows FROM inventory_t GROUP BY ALL",
)
def lakehouse_adhoc_sql(e: Estate) -> DataFrame:
    path = scratch_path(e.spark, "lakehouse")
    sources.write_lakehouse({"assets": inventory(e)}, path, {"assets": ["asset_type"]})
    return sources.query_lakehouse(
        e.spark,
        sources.open_lakehouse(e.spark, path, ["assets"]),
        "SELECT asset_type, certification_status, COUNT(*) AS assets, SUM(row_count) AS scanned_rows FROM {assets} GROUP BY ALL",
    )


def bundle(e: Estate) -> dict[str, DataFrame]:
    """All entities of the catalog written as a bundle and read back."""
    entities = {"tags": label_tags(e), "glossary_terms": catalog.label_terms(labels(e)), "assets": inventory(e)}
    path = scratch_path(e.spark, "bundle")
    sources.write_bundle(entities, path)
    return sources.read_bundle(e.spark, path, {n: df.schema for n, df in entities.items()})


register("catalog_bundle_roundtrip", lambda e: bundle(e)["tags"], "SELECT asset_id, tag_id, tag_name, tag_value, confidence, source FROM label_tags_t")
register("catalog_bundle_terms", lambda e: bundle(e)["glossary_terms"], "SELECT * FROM label_terms_t")
register("catalog_bundle_assets", lambda e: bundle(e)["assets"], "SELECT * FROM inventory_t")


def changed_parts(e: Estate) -> DataFrame:
    """Updates to the part table: every third part, some fields missing, and new keys."""
    key = F.col("p_partkey")
    part = e.table("part").filter(key % 3 == 0)
    return part.select(
        F.when(key % 2 == 0, key).otherwise(-key).alias("p_partkey"),
        F.when(key % 5 != 0, F.upper("p_name")).alias("p_name"),
        "p_brand",
        F.lit(None).cast("string").alias("p_type"),
        (F.col("p_size") + 1).alias("p_size"),
        F.when(key % 7 != 0, F.lit(1.5)).alias("p_retailprice"),
    )


define(
    "changed_parts_t",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -p_partkey END AS p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name) END AS p_name, p_brand,
    CAST(NULL AS VARCHAR) AS p_type, CAST(p_size + 1 AS INTEGER) AS p_size, CASE WHEN p_partkey % 7 <> 0 THEN 1.5::DOUBLE END AS p_retailprice FROM part WHERE p_partkey % 3 = 0""",
)
register(
    "catalog_sync_upsert",
    lambda e: sources.merge_by_key(e.table("part"), changed_parts(e), ["p_partkey"], "upsert"),
    """SELECT p_partkey, COALESCE(n.p_name, o.p_name) AS p_name, COALESCE(n.p_brand, o.p_brand) AS p_brand, COALESCE(n.p_type, o.p_type) AS p_type,
    COALESCE(n.p_size, o.p_size) AS p_size, COALESCE(n.p_retailprice, o.p_retailprice) AS p_retailprice FROM part o FULL JOIN changed_parts_t n USING (p_partkey)""",
)
register(
    "catalog_sync_replace",
    lambda e: sources.merge_by_key(e.table("part"), changed_parts(e), ["p_partkey"], "replace"),
    "SELECT * FROM changed_parts_t UNION ALL SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM changed_parts_t)",
)
register(
    "catalog_sync_append",
    lambda e: sources.merge_by_key(e.table("part"), changed_parts(e), ["p_partkey"], "append"),
    "SELECT * FROM part UNION ALL SELECT * FROM changed_parts_t",
)

# --- labels --------------------------------------------------------------------------------


def labels(e: Estate) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return e.table("labels").select(
        F.lit("documents").alias("table_name"),
        F.concat(F.lit("doc_"), key).alias("column_name"),
        F.when(F.col("toxic") == 1, "True").otherwise("False").alias("is_pii"),
        F.when(F.col("doc_id") % 4 != 0, "CONFIDENTIAL_NOTES").alias("pii_type"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Good document "), key)).alias("true_business_description"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Good Text "), (F.col("doc_id") % 10).cast("string"))).alias("glossary_term"),
    )


def label_tags(e: Estate) -> DataFrame:
    return catalog.label_tags(labels(e))


define(
    "label_tags_t",
    """SELECT sha256('estate.public.documents.doc_' || doc_id || '|PII') AS tag_id, 'estate.public.documents.doc_' || doc_id AS asset_id, 'PII' AS tag_name,
    CASE WHEN doc_id % 4 <> 0 THEN 'CONFIDENTIAL_NOTES' ELSE 'SENSITIVE' END AS tag_value, 1.0::DOUBLE AS confidence, 'GOLD_STANDARD' AS source FROM labels WHERE toxic = 1""",
)
register("labels_to_tags", label_tags, "SELECT * FROM label_tags_t")
define(
    "label_terms_t",
    """SELECT DISTINCT 'glossary.good_text_' || (doc_id % 10) AS term_id, 'Good Text ' || (doc_id % 10) AS term_name,
    'Standard enterprise definition for Good Text ' || (doc_id % 10) AS definition, 'Enterprise E-Commerce' AS domain FROM labels WHERE quality = 1""",
)
register(
    "labels_to_terms",
    lambda e: catalog.label_terms(labels(e)),
    "SELECT * FROM label_terms_t",
)
register(
    "labels_to_mappings",
    lambda e: catalog.label_mappings(labels(e).unionAll(labels(e))),
    """SELECT sha256('estate.public.documents.doc_' || doc_id || '|glossary.good_text_' || (doc_id % 10)) AS mapping_id, 'estate.public.documents.doc_' || doc_id AS asset_id,
    'glossary.good_text_' || (doc_id % 10) AS term_id, 1.0::DOUBLE AS confidence, 'GOLD_STANDARD' AS mapped_by FROM labels WHERE quality = 1""",
)
register(
    "labels_to_descriptions",
    lambda e: catalog.label_descriptions(labels(e)),
    "SELECT 'estate.public.documents.doc_' || doc_id AS asset_id, 'Good document ' || doc_id AS description FROM labels WHERE quality = 1",
)

# --- versioned assets ----------------------------------------------------------------------


def asset_changes(e: Estate) -> DataFrame:
    """Events as change requests: the user is the asset, and each request gives some fields only."""
    key = F.col("event_id")
    certified = F.col("event_type") == "purchase"
    return e.table("events").select(
        F.concat(F.lit("estate.user."), F.col("user_id").cast("string")).alias("asset_id"),
        "ts",
        "event_id",
        F.when(key % 3 != 0, F.concat(F.lit("About "), "props")).alias("description"),
        F.when(key % 4 == 0, F.col("event_type")).alias("owner"),
        F.when(certified, "CERTIFIED").when(key % 10 == 0, "REVIEW").alias("certification_status"),
        F.when(key % 5 == 0, F.col("value").cast("decimal(18,2)").cast("double")).alias("quality_score"),
        F.concat(F.lit("agent_"), (key % 7).cast("string")).alias("changed_by"),
    )


define(
    "asset_changes_t",
    """SELECT 'estate.user.' || user_id AS asset_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN 'About ' || props END AS description,
    CASE WHEN event_id % 4 = 0 THEN event_type END AS owner, CASE WHEN event_type = 'purchase' THEN 'CERTIFIED' WHEN event_id % 10 = 0 THEN 'REVIEW' END AS certification_status,
    CASE WHEN event_id % 5 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS quality_score, 'agent_' || (event_id % 7) AS changed_by FROM events""",
)
define(
    "asset_states_t",
    """SELECT asset_id, ts, event_id, changed_by, version, description AS req_description, owner AS req_owner, certification_status AS req_certification_status, quality_score AS req_quality_score,
    COALESCE(last_value(description IGNORE NULLS) OVER w, '') AS description, COALESCE(last_value(owner IGNORE NULLS) OVER w, 'Data Governance Guild') AS owner,
    COALESCE(last_value(certification_status IGNORE NULLS) OVER w, 'DRAFT') AS certification_status, COALESCE(last_value(quality_score IGNORE NULLS) OVER w, 1.0) AS quality_score
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts, event_id) AS version FROM asset_changes_t)
    WINDOW w AS (PARTITION BY asset_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)


def history(e: Estate) -> DataFrame:
    return catalog.asset_history(asset_changes(e), ["ts", "event_id"])


register(
    "asset_history",
    history,
    """SELECT sha256(asset_id || '|' || version) AS history_id, asset_id, version, CASE WHEN version > 1 THEN 'UPDATE' ELSE 'CREATE' END AS change_type, ts, event_id, changed_by,
    CASE WHEN version > 1 THEN CAST(to_json({'description': LAG(description) OVER w, 'owner': LAG(owner) OVER w, 'certification_status': LAG(certification_status) OVER w, 'quality_score': LAG(quality_score) OVER w, 'version': version - 1}) AS VARCHAR) END AS before_state,
    CAST(to_json({'description': req_description, 'owner': req_owner, 'certification_status': req_certification_status, 'quality_score': req_quality_score}) AS VARCHAR) AS after_state,
    description, owner, certification_status, quality_score FROM asset_states_t WINDOW w AS (PARTITION BY asset_id ORDER BY version)""",
)
register(
    "asset_current",
    lambda e: catalog.current_assets(history(e), "ts"),
    """SELECT asset_id, description, owner, certification_status, quality_score, version, created_at, ts AS updated_at
    FROM (SELECT *, MIN(ts) OVER (PARTITION BY asset_id) AS created_at FROM asset_states_t) QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY version DESC) = 1""",
)

def consumer_edges(e: Estate) -> DataFrame:
    return catalog.consumption_edges(e.spark, CONSUMERS)


define(
    "consumer_edges_t",
    "\nUNION ALL\n".join(
        f"SELECT asset_id AS source, '{asset}' AS target, 'DASHBOARD_CONSUMPTION' AS transformation_type, CAST({i} AS BIGINT) AS ordinal FROM inventory_t WHERE asset_id = 'estate.public.{table}'"
        for i, (asset, (_, table)) in enumerate(CONSUMERS.items())
    ),
)


@query("consumption_edges", "SELECT * FROM consumer_edges_t")
def consumption_edges(e: Estate) -> DataFrame:
    """The declared consumers of tables that are in the catalog."""
    tables = inventory(e).select(F.col("asset_id").alias("source"))
    return consumer_edges(e).join(tables, "source", "left_semi")


def _stored_sql(name: str, key: str, source: str) -> str:
    return f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT {key}) AS keys, MIN({key}) AS first_key, MAX({key}) AS last_key FROM {source}"


@query(
    "lakehouse_tables",
    "\nUNION ALL\n".join(
        [
            _stored_sql("assets", "asset_id", "inventory_t"),
            _stored_sql("tags", "tag_id", "label_tags_t"),
            _stored_sql("glossary_terms", "term_id", "(SELECT DISTINCT 'glossary.good_text_' || (doc_id % 10) AS term_id FROM labels WHERE quality = 1)"),
            _stored_sql(
                "glossary_mappings",
                "mapping_id",
                "(SELECT sha256('estate.public.documents.doc_' || doc_id || '|glossary.good_text_' || (doc_id % 10)) AS mapping_id FROM labels WHERE quality = 1)",
            ),
            _stored_sql("lineage_edges", "source", "consumer_edges_t"),
            _stored_sql("asset_history", "history_id", "(SELECT sha256(asset_id || '|' || version) AS history_id FROM asset_states_t)"),
        ]
    ),
)
def lakehouse_tables(e: Estate) -> DataFrame:
    """All six catalog tables exported as Parquet and read back: rows and keys of each."""
    path = scratch_path(e.spark, "lakehouse")
    tables = {
        "assets": (inventory(e), "asset_id"),
        "tags": (label_tags(e), "tag_id"),
        "glossary_terms": (catalog.label_terms(labels(e)), "term_id"),
        "glossary_mappings": (catalog.label_mappings(labels(e)), "mapping_id"),
        "lineage_edges": (consumer_edges(e), "source"),
        "asset_history": (history(e), "history_id"),
    }
    sources.write_lakehouse({n: df for n, (df, _) in tables.items()}, path, {"assets": ["asset_type"]})
    stored = sources.open_lakehouse(e.spark, path, list(tables))
    counted = [
        stored[n].agg(
            F.count(F.lit(1)).alias("row_count"),
            F.countDistinct(key).alias("keys"),
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
        ).select(F.lit(n).alias("table_name"), "*")
        for n, (_, key) in tables.items()
    ]
    return reduce(DataFrame.unionAll, counted)


# --- search, context, masking --------------------------------------------------------------


def assets(e: Estate) -> DataFrame:
    """A catalog whose tables are suppliers and whose columns are parts."""
    supplier, part = e.table("supplier"), e.table("part")
    table_id = F.concat(F.lit("est.pub.t"), F.col("s_suppkey").cast("string"))
    parent = F.concat(F.lit("est.pub.t"), F.expr("p_partkey div 20").cast("string"))
    none = F.lit(None).cast("string")
    listed = supplier.select(
        table_id.alias("asset_id"),
        F.lit("est").alias("parent_id"),
        F.lit("TABLE").alias("asset_type"),
        F.concat(F.when(F.col("s_suppkey") % 4 == 0, "stg_").otherwise("dim_"), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("display_name"),
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("Supplies from "), "s_name")).alias("description"),
        none.alias("data_type"),
        F.concat(F.lit("team_"), F.col("s_nationkey").cast("string")).alias("owner"),
        F.when(F.col("s_suppkey") % 3 == 0, "CERTIFIED").otherwise("DRAFT").alias("certification_status"),
        ((F.col("s_suppkey") % 100).cast("double") / 100).alias("quality_score"),
    )
    columns = part.select(
        F.concat(parent, F.lit(".c"), F.col("p_partkey").cast("string")).alias("asset_id"),
        parent.alias("parent_id"),
        F.lit("COLUMN").alias("asset_type"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        none.alias("display_name"),
        F.col("p_name").alias("description"),
        F.lower("p_type").alias("data_type"),
        none.alias("owner"),
        F.lit("DRAFT").alias("certification_status"),
        F.lit(1.0).alias("quality_score"),
    )
    return listed.unionByName(columns)


def tags(e: Estate) -> DataFrame:
    """PII tags on small parts (some twice), topic tags on large ones."""
    part = e.table("part")
    asset = F.concat(F.lit("est.pub.t"), F.expr("p_partkey div 20").cast("string"), F.lit(".c"), F.col("p_partkey").cast("string"))
    pii = part.filter("p_size < 10").select(asset.alias("asset_id"), F.lit("PII").alias("tag_name"), F.col("p_type").alias("tag_value"))
    twice = part.filter("p_size < 4").select(asset.alias("asset_id"), F.lit("PII").alias("tag_name"), F.col("p_brand").alias("tag_value"))
    topic = part.filter("p_size > 45").select(asset.alias("asset_id"), F.lit("TOPIC").alias("tag_name"), F.col("p_type").alias("tag_value"))
    return pii.unionAll(twice).unionAll(topic)


define(
    "assets_t",
    """SELECT 'est.pub.t' || s_suppkey AS asset_id, 'est' AS parent_id, 'TABLE' AS asset_type, CASE WHEN s_suppkey % 4 = 0 THEN 'stg_' ELSE 'dim_' END || s_suppkey AS name,
    CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS display_name, CASE WHEN s_suppkey % 5 <> 0 THEN 'Supplies from ' || s_name END AS description, CAST(NULL AS VARCHAR) AS data_type,
    'team_' || s_nationkey AS owner, CASE WHEN s_suppkey % 3 = 0 THEN 'CERTIFIED' ELSE 'DRAFT' END AS certification_status, CAST(s_suppkey % 100 AS DOUBLE) / 100 AS quality_score FROM supplier
    UNION ALL SELECT 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey, 'est.pub.t' || (p_partkey // 20), 'COLUMN', replace(p_name, ' ', '_') || '_' || p_partkey, NULL, p_name, lower(p_type), NULL, 'DRAFT', 1.0 FROM part""",
)
define(
    "tags_t",
    """SELECT 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey AS asset_id, 'PII' AS tag_name, p_type AS tag_value FROM part WHERE p_size < 10
    UNION ALL SELECT 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey, 'PII', p_brand FROM part WHERE p_size < 4
    UNION ALL SELECT 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey, 'TOPIC', p_type FROM part WHERE p_size > 45""",
)
define(
    "tagged_t",
    """SELECT a.*, t.n IS NOT NULL AS is_pii, COALESCE(t.v, 'NONE') AS pii_type FROM assets_t a
    LEFT JOIN (SELECT asset_id, COUNT(*) AS n, MIN(tag_value) AS v FROM tags_t WHERE tag_name = 'PII' GROUP BY asset_id) t ON a.asset_id = t.asset_id WHERE asset_type = 'COLUMN'""",
)
register("pii_tables", lambda e: catalog.pii_tables(assets(e), tags(e)), "SELECT DISTINCT parent_id AS table_id FROM tagged_t WHERE is_pii")
define(
    "asset_list_t",
    """SELECT asset_id, name, COALESCE(display_name, upper(name[1]) || replace(name, '_', ' ')[2:]) AS display_name, owner, certification_status, COALESCE(n, 0) AS total_columns, COALESCE(p, 0) AS pii_columns_count,
    COALESCE(c, '') AS columns, description FROM (FROM assets_t WHERE asset_type = 'TABLE') LEFT JOIN (SELECT parent_id AS k, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_pii) AS p, array_to_string(list(name ORDER BY name, asset_id)[1:8], '|') AS c FROM tagged_t GROUP BY ALL) ON asset_id = k""",
)


def flat_list(listed: DataFrame) -> DataFrame:
    return listed.withColumn("columns", joined(F.col("columns")))


register("asset_list", lambda e: flat_list(catalog.asset_list(assets(e), tags(e))), "SELECT * EXCLUDE (description) FROM asset_list_t")
register(
    "catalog_filter",
    lambda e: flat_list(catalog.asset_list(assets(e), tags(e), query="SUPPLIER#00000000", pii_only=True)),
    "SELECT * EXCLUDE (description) FROM asset_list_t WHERE (contains(name, 'supplier#00000000') OR contains(lower(description), 'supplier#00000000')) AND pii_columns_count > 0",
)


@query(
    "asset_quality",
    """SELECT table_name, asset_id, COALESCE(quality_score, 1.0) AS quality_score, COALESCE(certification_status, 'UNKNOWN') AS status
    FROM (SELECT 'dim_' || p_partkey AS table_name FROM part) LEFT JOIN (SELECT name AS table_name, asset_id, quality_score, certification_status FROM assets_t WHERE asset_type = 'TABLE') USING (table_name)""",
)
def asset_quality(e: Estate) -> DataFrame:
    names = e.table("part").select(F.concat(F.lit("dim_"), F.col("p_partkey").cast("string")).alias("table_name"))
    return catalog.asset_quality(names, assets(e))


def _context_sql(role: str, sees_all: bool) -> str:
    masked = "FALSE" if sees_all else "c.is_pii"
    return f"""SELECT t.asset_id, t.name, t.owner, t.certification_status, t.quality_score, c.asset_id AS column_asset_id, c.name AS column_name, c.data_type AS column_type, c.is_pii, c.pii_type,
    CASE WHEN c.asset_id IS NOT NULL THEN {masked} END AS is_masked, CASE WHEN {masked} THEN '{search.MASKING_POLICY}' END AS masking_policy, '{role}' AS caller_role
    FROM (FROM assets_t WHERE asset_type = 'TABLE') t LEFT JOIN tagged_t c ON c.parent_id = t.asset_id"""


def _context(e: Estate, role: str) -> DataFrame:
    return search.asset_context(assets(e), tags(e), role).drop("parent_id", "asset_type", "display_name", "description")


register("asset_context", lambda e: _context(e, "ANALYST"), _context_sql("ANALYST", False))
register("asset_context_steward", lambda e: _context(e, "COMPLIANCE_STEWARD"), _context_sql("COMPLIANCE_STEWARD", True))

CUSTOMER_PII = {"c_name": "PERSON_NAME", "c_custkey": "CUSTOMER_ID", "c_acctbal": "FINANCIAL", "c_mktsegment": "CONFIDENTIAL_NOTES"}
CUSTOMER_MASKS = {"c_custkey": "hash", "c_name": "partial", "c_acctbal": "null"}
register(
    "masked_customer_analyst",
    lambda e: search.mask_frame(e.table("customer"), CUSTOMER_PII, "ANALYST", CUSTOMER_MASKS, "estate"),
    """SELECT ('0x' || sha256('estate|' || c_custkey)[1:15])::BIGINT AS c_custkey, c_name[1:2] || repeat('*', length(c_name) - 2) AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal,
    '[RESTRICTED_CONFIDENTIAL_NOTES]' AS c_mktsegment FROM customer""",
)
register(
    "masked_customer_steward",
    lambda e: search.mask_frame(e.table("customer"), CUSTOMER_PII, "compliance_steward", CUSTOMER_MASKS),
    "SELECT * FROM customer",
)

SEARCHES = {"s1": "the on", "s2": "que la", "s3": "Thin and", "s4": "src1 der", "s5": "zzzz qqqq"}


def document_assets(e: Estate) -> DataFrame:
    return e.table("documents").select(
        F.col("doc_id").alias("asset_id"),
        F.upper("lang").alias("asset_type"),
        "source",
        F.concat_ws("_", "source", "lang").alias("name"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 50 == 0, "CERTIFIED").otherwise("DRAFT").alias("certification_status"),
    )


def _search_sql(queries: dict[str, str], where: str = "TRUE", limit: int = 10) -> str:
    parts = []
    for key, text in queries.items():
        phrase = text.lower()
        terms = [f"50 * CAST(contains(n, '{phrase}') AS INTEGER)", f"25 * CAST(contains(t, '{phrase}') AS INTEGER)"]
        for token in phrase.split():
            terms += [f"20 * CAST(contains(n, '{token}') AS INTEGER)", f"10 * CAST(contains(t, '{token}') AS INTEGER)"]
        parts.append(f"SELECT '{key}' AS query_id, asset_id, name, CAST({' + '.join(terms)} + CASE WHEN asset_id % 50 = 0 THEN 15 ELSE 0 END AS DOUBLE) AS relevance_score FROM docs")
    return f"""WITH docs AS (SELECT doc_id AS asset_id, source || '_' || lang AS name, lower(source || '_' || lang) AS n, lower(text) AS t FROM documents WHERE {where})
    SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, name, asset_id) AS INTEGER) AS rank
      FROM ({' UNION ALL '.join(parts)}) WHERE relevance_score > 0) WHERE rank <= {limit}"""


register("asset_search", lambda e: search.search(document_assets(e), {"s1": "the on"}, asset_type="en"), _search_sql({"s1": "the on"}, "lang = 'en'"))
register("asset_search_batch", lambda e: search.search(document_assets(e), SEARCHES, limit=25), _search_sql(SEARCHES, limit=25))



def document_queries(e: Estate) -> DataFrame:
    """The third to fifth word of every document, as a query."""
    words = F.slice(F.split(F.trim("text"), r"\s+", 6), 3, 3)
    # generated, so that the filter does not cut the text again
    query = F.explode(F.array(F.array_join(words, " "))).alias("query")
    return e.table("documents").select(F.col("doc_id").alias("query_id"), query).where("query <> ''")


@query(
    "asset_search_many",
    r"""WITH docs AS (SELECT doc_id AS asset_id, source || '_' || lang AS name, lower(source || '_' || lang) AS n, lower(text) AS t FROM documents),
    queries AS (SELECT doc_id AS query_id, lower(array_to_string(regexp_split_to_array(trim(text), '\s+')[3:5], ' ')) AS q FROM documents),
    asked AS (SELECT query_id, q, CASE WHEN len(w) > 0 THEN w ELSE [trim(q)] END AS w FROM (SELECT *, list_filter(string_split(q, ' '), lambda x: length(x) > 1) AS w FROM queries WHERE q <> '')),
    patterns AS (SELECT query_id, q AS pattern, 50 AS inname, 25 AS intext FROM asked UNION ALL SELECT query_id, unnest(w), 20, 10 FROM asked),
    found AS (SELECT p.pattern, asset_id, contains(n, p.pattern) AS inn, contains(t, p.pattern) AS int FROM (SELECT DISTINCT pattern FROM patterns) p, docs WHERE contains(n, p.pattern) OR contains(t, p.pattern)),
    hits AS (SELECT query_id, asset_id, SUM(inname * CAST(inn AS INTEGER) + intext * CAST(int AS INTEGER)) AS hits FROM patterns JOIN found USING (pattern) GROUP BY ALL),
    boosted AS (SELECT DISTINCT query_id, asset_id, 0 AS hits FROM (SELECT DISTINCT query_id FROM asked), (SELECT asset_id FROM docs WHERE asset_id % 50 = 0)),
    scored AS (SELECT query_id, asset_id, MAX(hits) AS hits FROM (SELECT * FROM hits UNION ALL SELECT * FROM boosted) GROUP BY ALL)
    SELECT query_id, asset_id, name, CAST(hits + CASE WHEN asset_id % 50 = 0 THEN 15 ELSE 0 END AS DOUBLE) AS relevance_score,
      CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY hits + CASE WHEN asset_id % 50 = 0 THEN 15 ELSE 0 END DESC, name, asset_id) AS INTEGER) AS rank
    FROM scored JOIN docs USING (asset_id) QUALIFY rank <= 10""",
)
def asset_search_many(e: Estate) -> DataFrame:
    """A search for every document, the queries being a table."""
    return search.search_queries(document_assets(e), document_queries(e))


GATE_WORDS = ("tion", "eau", "@", "ungen", "que la")


@query(
    "prompt_gate",
    """SELECT conv_id, turn, CASE WHEN hit THEN 'REFUSED_BY_POLICY' ELSE 'PERMITTED' END AS status, triggers, CASE WHEN hit THEN 'POL-002,POL-006' END AS policy_citation
    FROM (SELECT *, triggers <> '' AS hit FROM (SELECT conv_id, turn, array_to_string(list_filter(['tion', 'eau', '@', 'ungen', 'que la'], lambda w: contains(lower(text), w)), '|') AS triggers FROM conversations WHERE role = 'user'))""",
)
def prompt_gate(e: Estate) -> DataFrame:
    prompts = e.table("conversations").filter(F.col("role") == "user")
    return search.gate_prompts(prompts, "text", triggers=GATE_WORDS).drop("role", "text")
