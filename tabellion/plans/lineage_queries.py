"""Lineage over a graph of parts: a binary tree with shortcuts and back edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.operators import lineage, paths, policy
from tabellion.plans.binding import Estate
from tabellion.plans.catalog_queries import assets, tags
from tabellion.plans.oracle import define, half_up, with_tables
from tabellion.plans.registry import query

COMMON_TYPES = ("DIRECT_COPY", "AGGREGATION", "DERIVED_EXPRESSION")


def node(expression: Column) -> Column:
    return F.concat(F.lit("n"), expression.cast("string"))


def part_edges(e: Estate) -> DataFrame:
    """Parent to child, plus shortcuts to a later node and edges back to the parent."""
    key = F.col("p_partkey")
    part = e.table("part").select("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in COMMON_TYPES]), (key % 3).cast("int") + 1)
    parent = F.expr("(p_partkey - 1) div 2")
    tree = part.filter(key > 0).select(
        node(parent).alias("source"), node(key).alias("target"), kind.alias("transformation_type"), (key * 10).alias("ordinal")
    )
    shortcuts = part.filter(key % 10 == 0).select(
        node(key).alias("source"), node(key + 11).alias("target"), F.lit("DIRECT_COPY").alias("transformation_type"), (key * 10 + 1).alias("ordinal")
    )
    back = part.filter(key % 50 == 7).select(
        node(key).alias("source"), node(parent).alias("target"), F.lit("AGGREGATION").alias("transformation_type"), (key * 10 + 2).alias("ordinal")
    )
    return tree.unionAll(shortcuts).unionAll(back)


define(
    "part_edges_t",
    """SELECT 'n' || ((p_partkey - 1) // 2) AS source, 'n' || p_partkey AS target, CASE p_partkey % 3 WHEN 0 THEN 'DIRECT_COPY' WHEN 1 THEN 'AGGREGATION' ELSE 'DERIVED_EXPRESSION' END AS transformation_type, p_partkey * 10 AS ordinal FROM part WHERE p_partkey > 0
    UNION ALL SELECT 'n' || p_partkey, 'n' || (p_partkey + 11), 'DIRECT_COPY', p_partkey * 10 + 1 FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'n' || p_partkey, 'n' || ((p_partkey - 1) // 2), 'AGGREGATION', p_partkey * 10 + 2 FROM part WHERE p_partkey % 50 = 7""",
)


def recursive(tables: str, recursion: str, select: str) -> str:
    """A query over one recursive table, placed after the shared tables it reads."""
    shared = with_tables(f"SELECT * FROM {tables}").rsplit("\nSELECT", 1)[0]
    return f"{shared.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{recursion}\n{select}"


def walk_sql(roots: str, upstream: bool, select: str, edges: str = "part_edges_t", also: str = "") -> str:
    near, far = ("target", "source") if upstream else ("source", "target")
    return recursive(
        f"{edges}{also}",
        f"""hops AS (SELECT DISTINCT {near} AS a, {far} AS b, transformation_type FROM {edges}), roots AS ({roots}),
    walks AS (SELECT root, b AS node, CAST(1 AS BIGINT) AS depth, [root, b] AS path, transformation_type FROM roots JOIN hops ON a = root WHERE a <> b
      UNION ALL SELECT w.root, h.b, w.depth + 1, list_append(w.path, h.b), h.transformation_type FROM walks w JOIN hops h ON h.a = w.node WHERE NOT list_contains(w.path, h.b))""",
        select,
    )


def one_root(e: Estate, name: str) -> DataFrame:
    return e.spark.createDataFrame([(name,)], "root string")


@query(
    "lineage_downstream",
    walk_sql("SELECT 'n1' AS root", False, "SELECT DISTINCT root, node, depth, array_to_string(path, ' -> ') AS lineage_path, transformation_type FROM walks"),
)
def lineage_downstream(e: Estate) -> DataFrame:
    return lineage.downstream(part_edges(e), one_root(e, "n1"))


def large_parts(e: Estate) -> DataFrame:
    return e.table("part").filter("p_size > 40").select(node(F.col("p_partkey")).alias("root"))


@query(
    "lineage_upstream",
    walk_sql(
        "SELECT 'n' || p_partkey AS root FROM part WHERE p_size > 40",
        True,
        "SELECT DISTINCT root, node, depth, array_to_string(path, ' <- ') AS lineage_path, transformation_type FROM walks",
    ),
)
def lineage_upstream(e: Estate) -> DataFrame:
    return lineage.upstream(part_edges(e), large_parts(e))


@query(
    "lineage_both",
    walk_sql(
        "SELECT 'n' || p_partkey AS root FROM part WHERE p_size > 40",
        True,
        """, down AS (SELECT root, target AS node, CAST(1 AS BIGINT) AS depth, [root, target] AS path FROM roots JOIN (SELECT DISTINCT source, target, transformation_type FROM part_edges_t) ON source = root
      UNION ALL SELECT w.root, h.b, w.depth + 1, list_append(w.path, h.b) FROM down w JOIN (SELECT DISTINCT source AS a, target AS b, transformation_type FROM part_edges_t) h ON h.a = w.node WHERE NOT list_contains(w.path, h.b))
    SELECT root, 'UPSTREAM' AS direction, COUNT(*) AS paths, COUNT(DISTINCT node) AS nodes FROM walks GROUP BY root
    UNION ALL SELECT root, 'DOWNSTREAM', COUNT(*), COUNT(DISTINCT node) FROM down GROUP BY root""",
    ),
)
def lineage_both(e: Estate) -> DataFrame:
    return paths.both_ways(part_edges(e), large_parts(e)).withColumn("paths", F.col("paths").cast("bigint"))


@query(
    "lineage_path_counts",
    walk_sql(
        "SELECT 'n' || p_partkey AS root FROM part WHERE p_size > 40",
        True,
        "SELECT root, node, COUNT(*) AS paths, MIN(depth) AS shortest FROM walks GROUP BY root, node",
    ),
)
def lineage_path_counts(e: Estate) -> DataFrame:
    found = paths.PathIndex(part_edges(e)).paths_from(large_parts(e), upstream=True)
    return found.counts().withColumn("paths", F.col("paths").cast("bigint"))


@query(
    "lineage_path_counts_near",
    walk_sql(
        "SELECT 'n' || p_partkey AS root FROM part WHERE p_size > 40",
        False,
        "SELECT root, node, COUNT(*) AS paths, MIN(depth) AS shortest FROM walks WHERE depth <= 4 GROUP BY root, node",
    ),
)
def lineage_path_counts_near(e: Estate) -> DataFrame:
    """Numbers of downstream paths of at most four edges."""
    found = paths.PathIndex(part_edges(e)).paths_from(large_parts(e), max_depth=4)
    return found.counts().withColumn("paths", F.col("paths").cast("bigint"))


@query(
    "lineage_predecessors",
    walk_sql(
        "SELECT 'n' || p_partkey AS root FROM part WHERE p_size > 45",
        True,
        "SELECT root, path[len(path) - 1] AS previous, node, transformation_type, COUNT(*) AS paths FROM walks GROUP BY ALL",
    ),
)
def lineage_predecessors(e: Estate) -> DataFrame:
    """The edges that upstream paths end in, in place of the paths."""
    roots = e.table("part").filter("p_size > 45").select(node(F.col("p_partkey")).alias("root"))
    found = paths.PathIndex(part_edges(e)).paths_from(roots, upstream=True)
    return found.last_edges().withColumn("paths", F.col("paths").cast("bigint"))


@query(
    "lineage_closure",
    recursive(
        "part_edges_t",
        """walks AS (SELECT 'n' || p_partkey AS root, 'n' || p_partkey AS node, CAST(0 AS BIGINT) AS depth FROM part WHERE p_size > 40
      UNION SELECT w.root, e.target, w.depth + 1 FROM walks w JOIN part_edges_t e ON e.source = w.node WHERE w.depth < 40)""",
        "SELECT root, node, MIN(depth) AS depth FROM walks WHERE node <> root GROUP BY root, node",
    ),
)
def lineage_closure(e: Estate) -> DataFrame:
    return lineage.closure(part_edges(e), large_parts(e))


def tagged_parts(e: Estate) -> DataFrame:
    return e.table("part").filter("p_size < 5").select(
        node(F.col("p_partkey")).alias("root"),
        F.lit("PII").alias("tag_name"),
        F.col("p_type").alias("tag_value"),
        F.lit(1.0).alias("confidence"),
    )


PROPAGATED = """seeds AS (SELECT 'n' || p_partkey AS root, p_type AS tag_value FROM part WHERE p_size < 5),
    walks AS (SELECT root, tag_value, root AS node, 0 AS hop, CAST([] AS BIGINT[]) AS ord, 1.0::DOUBLE AS confidence, [root || ' [PII:' || tag_value || ']'] AS chain, [root] AS path FROM seeds
      UNION ALL SELECT w.root, w.tag_value, e.target, w.hop + 1, list_append(w.ord, e.ordinal), w.confidence * CASE e.transformation_type WHEN 'DIRECT_COPY' THEN 0.98::DOUBLE ELSE 0.9::DOUBLE END,
        list_append(w.chain, e.target || ' (' || e.transformation_type || ')'), list_append(w.path, e.target) FROM walks w JOIN part_edges_t e ON e.source = w.node WHERE NOT list_contains(w.path, e.target)),
    firsts AS (SELECT * FROM walks QUALIFY ROW_NUMBER() OVER (PARTITION BY root, tag_value, node ORDER BY hop, ord) = 1),
    spread AS (SELECT f.root, 'PII' AS tag_name, f.tag_value, e.target AS node, f.confidence * CASE e.transformation_type WHEN 'DIRECT_COPY' THEN 0.98::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
      CAST(f.hop + 1 AS BIGINT) AS hop_count, array_to_string(list_append(f.chain, e.target || ' (' || e.transformation_type || ')'), ' -> ') AS reason_chain FROM firsts f JOIN part_edges_t e ON e.source = f.node)"""


@query("tag_propagation", recursive("part_edges_t", PROPAGATED, "SELECT * FROM spread"))
def tag_propagation(e: Estate) -> DataFrame:
    found = lineage.propagate(part_edges(e), tagged_parts(e))
    return found.withColumn("reason_chain", F.array_join("reason_chain", " -> "))


@query(
    "policy_tag_coverage",
    recursive(
        "part_edges_t",
        PROPAGATED,
        """SELECT CASE WHEN k % 17 = 0 THEN 'POL-007' ELSE 'POL-008' END AS policy_id, node AS asset_id, 'PII' AS tag_name, paths
        FROM (SELECT node, CAST(node[2:] AS BIGINT) AS k, COUNT(*) AS paths FROM spread GROUP BY node) WHERE k % 17 = 0 OR k % 23 = 0""",
    ),
)
def policy_tag_coverage(e: Estate) -> DataFrame:
    """Tags that should have been propagated, against a tag table with some lost and some unexplained."""
    expected = lineage.propagate(part_edges(e), tagged_parts(e)).withColumnRenamed("node", "asset_id")
    number = F.substring("asset_id", 2, 20).cast("bigint")
    bare = F.array().cast("array<string>")
    stored = expected.filter(number % 17 != 0).select(
        "asset_id", "tag_name", F.when(number % 23 == 0, bare).otherwise(F.col("reason_chain")).alias("reason_chain")
    )
    return policy.tag_coverage(expected, stored)


# --- declared models ------------------------------------------------------------------------


def specs(e: Estate) -> DataFrame:
    """Column specifications derived from parts: every column reads the columns at half and a third of its key."""
    key = F.col("p_partkey")
    table, column = F.concat(F.lit("m"), F.expr("p_partkey div 10").cast("string")), F.concat(F.lit("c"), key.cast("string"))

    def source(expression: str):
        number = F.expr(expression)
        return F.struct(
            F.concat(F.lit("m"), F.expr(f"({expression}) div 10").cast("string")).alias("table"),
            F.concat(F.lit("c"), number.cast("string")).alias("column"),
        )

    kind = F.element_at(F.array(*[F.lit(k) for k in ("column", "aggregate", "expression", "window")]), (key % 4).cast("int") + 1)
    return e.table("part").filter(key > 2).select(
        table.alias("target_table"),
        column.alias("target_column"),
        kind.alias("kind"),
        F.when(key % 4 != 0, F.col("p_name")).alias("expression"),
        F.array(source("p_partkey div 2"), source("p_partkey div 3")).alias("sources"),
    )


define(
    "column_edges_t",
    """SELECT 'm' || (s // 10) AS source_table, 'c' || s AS source_column, 'm' || (p_partkey // 10) AS target_table, 'c' || p_partkey AS target_column,
    CASE p_partkey % 4 WHEN 0 THEN 'DIRECT_COPY' WHEN 1 THEN 'AGGREGATION' WHEN 2 THEN 'DERIVED_EXPRESSION' ELSE 'COMPUTED' END AS transformation_type,
    CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS expression, CAST(position AS INTEGER) AS position
    FROM (SELECT *, p_partkey // 2 AS s, 0 AS position FROM part WHERE p_partkey > 2 UNION ALL SELECT *, p_partkey // 3, 1 FROM part WHERE p_partkey > 2)""",
)


@query("lineage_edges", "SELECT * FROM column_edges_t")
def lineage_edges(e: Estate) -> DataFrame:
    return lineage.column_edges(specs(e))


def found_edges(e: Estate) -> DataFrame:
    """The declared edges with some lost and some tables found under a longer name."""
    number = F.substring("target_column", 2, 20).cast("bigint")
    edges = lineage.column_edges(specs(e)).filter((number % 37 != 0) | (F.col("position") == 0))
    return edges.withColumn("source_table", F.when(number % 5 == 0, F.concat(F.lit("cte_"), "source_table")).otherwise(F.col("source_table")))


def gold(e: Estate) -> DataFrame:
    return specs(e).select("target_table", "target_column", F.col("sources").alias("expected_sources"))


define(
    "lineage_verdicts_t",
    """SELECT target_table, target_column, COUNT(DISTINCT source_table || source_column) AS expected,
    CAST(CASE WHEN CAST(target_column[2:] AS BIGINT) % 37 = 0 AND COUNT(DISTINCT source_column) = 2 THEN 1 ELSE 0 END AS BIGINT) AS missing FROM column_edges_t GROUP BY target_table, target_column""",
)


@query("lineage_eval", "SELECT *, missing = 0 AS correct FROM lineage_verdicts_t")
def lineage_eval(e: Estate) -> DataFrame:
    return lineage.accuracy(found_edges(e), gold(e))[0]


@query(
    "lineage_accuracy",
    f"""SELECT COUNT(*) AS total_hand_verified, COUNT(*) FILTER (WHERE missing = 0) AS correct, COUNT(*) FILTER (WHERE missing > 0) AS failures_count,
    {half_up('COUNT(*) FILTER (WHERE missing = 0)', 'COUNT(*)', 2, 100)} AS accuracy_percentage FROM lineage_verdicts_t""",
)
def lineage_accuracy(e: Estate) -> DataFrame:
    return lineage.accuracy(found_edges(e), gold(e))[1]


@query(
    "openlineage_events",
    """SELECT target_table, '{"eventType":"COMPLETE","eventTime":"2024-01-01T00:00:00Z","run":{"runId":"' || sha256(target_table) || '"},"job":{"namespace":"estate","name":"model.' || target_table
      || '"},"inputs":[' || (SELECT string_agg(DISTINCT '{"namespace":"estate","name":"' || x || '"}', ',' ORDER BY '{"namespace":"estate","name":"' || x || '"}') FROM (SELECT unnest(all_sources) AS x))
      || '],"outputs":[{"namespace":"estate","name":"' || target_table || '","facets":{"columnLineage":{"fields":{' || fields || '}}}}],"producer":"tabellion"}' AS event
    FROM (SELECT target_table, flatten(list(sources)) AS all_sources, string_agg('"' || target_column || '":{"inputFields":[' || inputs || '],"transformationDescription":"' || why || '","transformationType":"' || kind || '"}', ',' ORDER BY target_column) AS fields
      FROM (SELECT target_table, target_column, list(DISTINCT source_table) AS sources, MIN(transformation_type) AS kind, COALESCE(MIN(expression), MIN(transformation_type)) AS why,
          string_agg(DISTINCT '{"namespace":"estate","name":"' || source_table || '","field":"' || source_column || '"}', ',' ORDER BY '{"namespace":"estate","name":"' || source_table || '","field":"' || source_column || '"}') AS inputs
        FROM column_edges_t GROUP BY target_table, target_column) GROUP BY target_table)""",
)
def openlineage_events(e: Estate) -> DataFrame:
    return lineage.run_events(lineage.column_edges(specs(e)), "estate", "2024-01-01T00:00:00Z", "tabellion")


# --- table graph ----------------------------------------------------------------------------


def asset_edges(e: Estate) -> DataFrame:
    """Column edges between the catalog's columns, and consumption edges into dashboards."""
    key = F.col("p_partkey")
    part = e.table("part").select("p_partkey")

    def column(expression: str):
        return F.concat(F.lit("est.pub.t"), F.expr(f"({expression}) div 20").cast("string"), F.lit(".c"), F.expr(expression).cast("string"))

    kind = F.when(key % 2 == 0, "DIRECT_COPY").otherwise("AGGREGATION")
    columns = part.filter(key > 0).select(
        column("(p_partkey - 1) div 2").alias("source"), column("p_partkey").alias("target"), kind.alias("transformation_type"), key.alias("ordinal")
    )
    supplier = e.table("supplier")
    board = F.concat(F.lit("dashboard.d"), F.col("s_nationkey").cast("string"))
    table = F.concat(F.lit("est.pub.t"), F.col("s_suppkey").cast("string"))
    parent = F.concat(F.lit("est.pub.t"), F.expr("(s_suppkey - 1) div 2").cast("string"))
    consumed = supplier.filter("s_suppkey % 7 = 0").select(
        table.alias("source"), board.alias("target"), F.lit("DASHBOARD_CONSUMPTION").alias("transformation_type"), F.col("s_suppkey").alias("ordinal")
    )
    tables = supplier.filter("s_suppkey > 0").select(
        parent.alias("source"), table.alias("target"), F.lit("JOIN_DIM").alias("transformation_type"), F.col("s_suppkey").alias("ordinal")
    )
    direct = part.filter(key % 101 == 0).select(
        column("p_partkey").alias("source"),
        F.concat(F.lit("dashboard.d"), (key % 25).cast("string")).alias("target"),
        F.lit("DASHBOARD_CONSUMPTION").alias("transformation_type"),
        key.alias("ordinal"),
    )
    return columns.unionAll(consumed).unionAll(tables).unionAll(direct)


define(
    "asset_edges_t",
    """SELECT 'est.pub.t' || ((p_partkey - 1) // 2 // 20) || '.c' || ((p_partkey - 1) // 2) AS source, 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey AS target,
    CASE WHEN p_partkey % 2 = 0 THEN 'DIRECT_COPY' ELSE 'AGGREGATION' END AS transformation_type, p_partkey AS ordinal FROM part WHERE p_partkey > 0
    UNION ALL SELECT 'est.pub.t' || s_suppkey, 'dashboard.d' || s_nationkey, 'DASHBOARD_CONSUMPTION', s_suppkey FROM supplier WHERE s_suppkey % 7 = 0
    UNION ALL SELECT 'est.pub.t' || ((s_suppkey - 1) // 2), 'est.pub.t' || s_suppkey, 'JOIN_DIM', s_suppkey FROM supplier WHERE s_suppkey > 0
    UNION ALL SELECT 'est.pub.t' || (p_partkey // 20) || '.c' || p_partkey, 'dashboard.d' || (p_partkey % 25), 'DASHBOARD_CONSUMPTION', p_partkey FROM part WHERE p_partkey % 101 = 0""",
)
define(
    "rolled_t",
    """SELECT source, target, first(transformation_type ORDER BY ordinal, transformation_type) AS transformation_type
    FROM (SELECT array_to_string(string_split(source, '.')[1:3], '.') AS source, array_to_string(string_split(target, '.')[1:3], '.') AS target, transformation_type, ordinal FROM asset_edges_t)
    WHERE source <> target GROUP BY source, target""",
)


def ordered_asset_edges(e: Estate) -> DataFrame:
    """The edges with ordinals that no two share."""
    rank = F.struct("ordinal", "transformation_type")
    return asset_edges(e).withColumn("ordinal", rank)


@query("table_lineage_rollup", "SELECT * FROM rolled_t")
def table_lineage_rollup(e: Estate) -> DataFrame:
    return lineage.roll_up(ordered_asset_edges(e))


def nodes(e: Estate) -> DataFrame:
    from tabellion.operators.catalog import pii_tables

    return lineage.graph_nodes(assets(e), pii_tables(assets(e), tags(e)))


define("pii_tables_t", "SELECT DISTINCT parent_id AS id FROM tagged_t WHERE is_pii")


@query(
    "lineage_graph_nodes",
    """SELECT asset_id AS id, COALESCE(display_name, name) AS label, asset_type, CASE WHEN contains(name, 'raw_') THEN 'raw' WHEN contains(name, 'stg_') THEN 'staging' WHEN contains(asset_id, 'dashboard') THEN 'dashboard' ELSE 'marts' END AS tier,
    asset_id IN (SELECT id FROM pii_tables_t) AS has_pii, certification_status, owner FROM assets_t WHERE asset_type = 'TABLE'""",
)
def lineage_graph_nodes(e: Estate) -> DataFrame:
    return nodes(e)


@query(
    "lineage_graph_edges",
    """SELECT source, target, transformation_type, source IN (SELECT id FROM pii_tables_t) AS is_pii_propagated
    FROM (SELECT * FROM rolled_t UNION ALL SELECT 'est.pub.t' || s_suppkey, 'est.pub.t' || (s_suppkey * 2 + 1), 'FACT_GRAIN' FROM supplier WHERE ('est.pub.t' || s_suppkey, 'est.pub.t' || (s_suppkey * 2 + 1)) NOT IN (SELECT (source, target) FROM rolled_t))""",
)
def lineage_graph_edges(e: Estate) -> DataFrame:
    key = F.col("s_suppkey")
    topology = e.table("supplier").select(
        F.concat(F.lit("est.pub.t"), key.cast("string")).alias("source"),
        F.concat(F.lit("est.pub.t"), (key * 2 + 1).cast("string")).alias("target"),
        F.lit("FACT_GRAIN").alias("transformation_type"),
    )
    return lineage.graph_edges(ordered_asset_edges(e), topology, nodes(e))


@query(
    "certified_pii_dashboards",
    walk_sql(
        "SELECT DISTINCT target AS root FROM asset_edges_t WHERE contains(target, 'dashboard')",
        True,
        """SELECT DISTINCT a.name AS table_name, a.certification_status, a.owner, c.name AS column_name, t.tag_value AS pii_type, array_to_string(list_reverse(path[1:len(path) - 1]), ' -> ') AS consumed_by_dashboard
        FROM assets_t a JOIN assets_t c ON c.parent_id = a.asset_id JOIN tags_t t ON t.asset_id = c.asset_id AND t.tag_name LIKE 'PII%' JOIN walks w ON w.node = a.asset_id OR w.node = c.asset_id
        WHERE a.asset_type = 'TABLE' AND a.certification_status = 'CERTIFIED'""",
        edges="asset_edges_t",
        also=", assets_t, tags_t",
    ),
)
def certified_pii_dashboards(e: Estate) -> DataFrame:
    return lineage.certified_pii_consumption(assets(e), tags(e), asset_edges(e))
