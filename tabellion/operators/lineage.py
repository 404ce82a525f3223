"""Lineage as an edge table: traversal, closure, tag propagation, roll-up, export.

Edges have ``source``, ``target``, ``transformation_type`` and ``ordinal`` (their insertion
order). Traversals advance one hop per join for all roots at once; the edges and each frontier
are checkpointed, so a hop neither recomputes earlier work nor depends on a lost executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.columns import first_match, ratio, stable_id
from tabellion.functions.ordered import OrderedGroups
from tabellion.session import checkpointed

COMPACT_LEVELS = 8
# fixed values: confidence factors, transformation types
COPY_FACTOR, OTHER_FACTOR = 0.98, 0.90
DIRECT_COPY = "DIRECT_COPY"
TRANSFORMATIONS = {"column": DIRECT_COPY, "aggregate": "AGGREGATION", "expression": "DERIVED_EXPRESSION"}
COMPUTED = "COMPUTED"


def column_edges(specs: DataFrame) -> DataFrame:
    """One edge per declared source of each target column.

    ``specs``: target_table, target_column, kind ('column', 'aggregate', 'expression' or
    other), expression and sources (array of struct<table, column>).
    """
    kind = first_match([(F.col("kind") == k, t) for k, t in TRANSFORMATIONS.items()], COMPUTED)
    listed = specs.withColumn("transformation_type", kind).select("*", F.posexplode("sources").alias("position", "s"))
    return listed.select(
        F.col("s.table").alias("source_table"),
        F.col("s.column").alias("source_column"),
        "target_table",
        "target_column",
        "transformation_type",
        "expression",
        "position",
    )


def traverse(edges: DataFrame, roots: DataFrame, upstream: bool = False, max_depth: int | None = None) -> DataFrame:
    """All simple paths from each root (column ``root``), of at most ``max_depth`` edges if that is given.

    Gives root, node (the end of the path), depth, path (array, root first) and the type of
    the last edge. A node never repeats on a path, so cycles end. The number of paths can be
    far larger than that of nodes; ``closure`` tells what is reached without listing paths.
    """
    near, far = ("target", "source") if upstream else ("source", "target")
    hops = checkpointed(
        edges.select(F.col(near).alias("_near"), F.col(far).alias("_far"), "transformation_type").distinct()
    )
    start = roots.select("root").distinct()
    frontier = start.select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    levels: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth or not levels:
        depth += 1
        step = frontier.join(hops, F.col("node") == F.col("_near")).filter(~F.array_contains("path", F.col("_far")))
        reached = checkpointed(
            step.select(
                "root",
                F.col("_far").alias("node"),
                F.lit(depth).cast("bigint").alias("depth"),
                F.concat("path", F.array("_far")).alias("path"),
                "transformation_type",
            )
        )
        levels.append(reached)
        if reached.isEmpty():
            break
        frontier = reached.select("root", "node", "path")
    return reduce(DataFrame.unionAll, levels)


def downstream(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    found = traverse(edges, roots, False, max_depth)
    return found.withColumn("lineage_path", F.array_join("path", " -> ")).drop("path").distinct()


def upstream(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    found = traverse(edges, roots, True, max_depth)
    return found.withColumn("lineage_path", F.array_join("path", " <- ")).drop("path").distinct()


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node reachable from each root with its shortest distance; each node is expanded once per root."""
    start = roots.select("root").distinct().select("root", F.col("root").alias("node"))
    return _spread(edges, start, max_depth)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that any root leads to; all roots spread as one, so each node is expanded once."""
    start = roots.select(F.lit("").alias("root"), F.col("root").alias("node")).distinct()
    return _spread(edges, start, None).select("node")


def _spread(edges: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    hops = checkpointed(edges.select(F.col("source").alias("_near"), F.col("target").alias("_far")).distinct())
    frontier = checkpointed(start.withColumn("depth", F.lit(0).cast("bigint")))
    levels = [frontier]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        visited = reduce(DataFrame.unionAll, levels).select("root", "node")
        reached = (
            frontier.join(hops, F.col("node") == F.col("_near"))
            .select("root", F.col("_far").alias("node"))
            .distinct()
            .join(visited, ["root", "node"], "left_anti")
        )
        frontier = checkpointed(reached.withColumn("depth", F.lit(depth).cast("bigint")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        levels = checkpoint_levels(levels)
    return reduce(DataFrame.unionAll, levels).filter(F.col("depth") > 0)


def checkpoint_levels(levels: list[DataFrame]) -> list[DataFrame]:
    """Many levels as one checkpoint, so that long traversals do not read ever more small files."""
    if len(levels) <= COMPACT_LEVELS:
        return levels
    return [checkpointed(narrowed(reduce(DataFrame.unionAll, levels)))]


class Levels:
    """The levels of a traversal, merged into checkpoints as they add up.

    As many levels as ``COMPACT_LEVELS`` become one, as many of those one again, so that a row is
    rewritten as often as the logarithm of the number of levels.
    """

    def __init__(self):
        self.tiers: list[list[DataFrame]] = []

    def add(self, level: DataFrame) -> None:
        for tier in self.tiers:
            tier.append(level)
            if len(tier) <= COMPACT_LEVELS:
                return
            level = checkpointed(narrowed(reduce(DataFrame.unionAll, tier)))
            tier.clear()
        self.tiers.append([level])

    def frames(self) -> list[DataFrame]:
        return [level for tier in reversed(self.tiers) for level in tier]

    def union(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.frames())


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as a shuffle has, so that unions in a loop do not add up ever more of them."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def propagate(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Carries tags downstream from all seeds at once, to the end or for ``max_hops`` hops.

    ``seeds``: root, tag_name, tag_value, confidence (of repeated seeds the highest). Every
    traversed edge gives a row; a node is expanded only from its first visit, which is the one
    whose edges come first in breadth-first order. Within a hop that order is the rank of the
    visits of the hop before, then the edge's ordinal, so a visit is a row of fixed width: its
    node, rank, confidence and the node before. The reason chains are put together at the end, hop
    by hop.
    """
    # tags are numbered while they travel
    tags = checkpointed(
        seeds.groupBy("root", "tag_name", "tag_value").agg(F.max(F.col("confidence").cast("double")).alias("confidence"))
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    hops = edges.select(F.col("source").alias("_near"), F.col("target").alias("_far"), "transformation_type")
    carried = _chains(_visits(edges, tags, max_hops), tags).join(hops, F.col("node") == F.col("_near")).select(
        "_tag",
        F.col("_far").alias("node"),
        (F.col("confidence") * _factor()).alias("confidence"),
        (F.col("hop") + 1).alias("hop_count"),
        F.concat("reason_chain", F.array(F.concat("_far", F.lit(" ("), "transformation_type", F.lit(")")))).alias("reason_chain"),
    )
    named = carried.join(tags.select("_tag", "root", "tag_name", "tag_value"), "_tag")
    return named.select("root", "tag_name", "tag_value", "node", "confidence", "hop_count", "reason_chain")


def _factor() -> Column:
    return F.when(F.col("transformation_type") == DIRECT_COPY, COPY_FACTOR).otherwise(OTHER_FACTOR)


def _visits(edges: DataFrame, tags: DataFrame, max_hops: int | None) -> list[DataFrame]:
    """(_tag, node, confidence, previous, transformation_type) of every first visit, one frame per hop.

    A node with one edge into it is reached once by a tag, when the node before is expanded, unless
    the tag starts there. Only visits of other nodes are compared with those before.
    """
    hops = edges.select(
        F.col("source").alias("_near"), F.col("target").alias("_far"), "transformation_type", F.col("ordinal").cast("bigint").alias("ordinal")
    ).where("_far is not null")
    often = hops.select("_far").unionAll(tags.select("root")).groupBy("_far").count().where("count > 1").select("_far", F.lit(True).alias("_again"))
    hops = checkpointed(hops.join(often, "_far", "left").withColumn("_again", F.col("_again").isNotNull()))
    shown = ["_tag", "node", "confidence", "previous", "transformation_type"]
    none = F.lit(None).cast("string")
    frontier = tags.select("_tag", F.col("root").alias("node"), "confidence", none.alias("previous"), none.alias("transformation_type"), F.lit(1).cast("bigint").alias("_rank"))
    levels, visited, hop = [frontier.select(*shown)], [frontier.select("_tag", "node")], 0
    while max_hops is None or hop < max_hops - 1:
        hop += 1
        step = checkpointed(
            frontier.select("_tag", F.col("node").alias("previous"), F.col("confidence").alias("_before"), "_rank")
            .join(hops, F.col("previous") == F.col("_near"))
            .select("_tag", F.col("_far").alias("node"), "previous", "_before", "transformation_type", "_rank", "ordinal", "_again")
        )
        reached = step.columns[2:-1]
        first = F.min_by(F.struct(*reached), F.struct("_rank", "ordinal")).alias("b")
        before = reduce(DataFrame.unionAll, visited)
        checked = step.where("_again").join(before, ["_tag", "node"], "left_anti").groupBy("_tag", "node").agg(first)
        checked = checkpointed(checked.select("_tag", "node", "b.*"))
        fresh = step.where("not _again").drop("_again").unionByName(checked)
        fresh = fresh.withColumn("confidence", F.col("_before") * _factor()).select(*shown, F.col("_rank").alias("_parent"), "ordinal")
        ranked = OrderedGroups(fresh, ["_tag"], ["_parent", "ordinal", "node"])
        if not ranked.rows:
            break
        levels.append(fresh.select(*shown))
        visited = checkpoint_levels([*visited, checked.select("_tag", "node")])
        frontier = ranked.row_number("_rank").select(*shown, "_rank")
    return levels


def _chains(levels: list[DataFrame], tags: DataFrame) -> DataFrame:
    """The visits of all hops with ``hop`` and ``reason_chain``, the visits that lead to each; a chain is copied once, to the next hop."""
    seed = F.concat("root", F.lit(" ["), "tag_name", F.lit(":"), "tag_value", F.lit("]"))
    chains = tags.select("_tag", F.col("root").alias("node"), "confidence", F.array(seed).alias("reason_chain"))
    kept, step = Levels(), F.concat("node", F.lit(" ("), "transformation_type", F.lit(")"))
    kept.add(chains.withColumn("hop", F.lit(0).cast("bigint")))
    for hop, level in enumerate(levels[1:], 1):
        above = chains.select("_tag", F.col("node").alias("previous"), F.col("reason_chain").alias("_above"))
        chains = checkpointed(
            level.join(above, ["_tag", "previous"]).select("_tag", "node", "confidence", F.concat("_above", F.array(step)).alias("reason_chain"))
        )
        kept.add(chains.withColumn("hop", F.lit(hop).cast("bigint")))
    return kept.union()


def roll_up(edges: DataFrame, parts: int = 3) -> DataFrame:
    """Column edges as table edges: ids cut to ``parts`` dotted parts, first type per pair, no self-edges."""
    cut = edges.select(
        F.substring_index("source", ".", parts).alias("source"),
        F.substring_index("target", ".", parts).alias("target"),
        "transformation_type",
        "ordinal",
    ).filter(F.col("source") != F.col("target"))
    return cut.groupBy("source", "target").agg(F.min_by("transformation_type", "ordinal").alias("transformation_type"))


def graph_nodes(assets: DataFrame, pii_tables: DataFrame) -> DataFrame:
    """Tables and dashboards with their tier and whether a column of theirs is PII."""
    tier = first_match(
        [
            (F.col("name").contains("raw_"), "raw"),
            (F.col("name").contains("stg_"), "staging"),
            (F.col("asset_id").contains("dashboard"), "dashboard"),
        ],
        "marts",
    )
    flagged = pii_tables.select(F.col("table_id").alias("_pii")).distinct()
    nodes = assets.filter(F.col("asset_type").isin("TABLE", "DASHBOARD"))
    return nodes.join(flagged, F.col("asset_id") == F.col("_pii"), "left").select(
        F.col("asset_id").alias("id"),
        F.coalesce("display_name", "name").alias("label"),
        "asset_type",
        tier.alias("tier"),
        F.col("_pii").isNotNull().alias("has_pii"),
        "certification_status",
        "owner",
    )


def graph_edges(edges: DataFrame, topology: DataFrame, nodes: DataFrame, parts: int = 3) -> DataFrame:
    """Rolled-up edges plus declared topology links that are not among them, flagged if PII flows."""
    found = roll_up(edges, parts)
    declared = topology.select("source", "target", "transformation_type").join(found, ["source", "target"], "left_anti")
    sensitive = nodes.filter("has_pii").select(F.col("id").alias("_pii"))
    every = found.unionByName(declared)
    return every.join(sensitive, F.col("source") == F.col("_pii"), "left").select(
        "source", "target", "transformation_type", F.col("_pii").isNotNull().alias("is_pii_propagated")
    )


def certified_pii_consumption(assets: DataFrame, tags: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Certified tables with PII columns that reach a dashboard, and by which path.

    The path may start at the table or at the column; the two cases are separate equality
    joins, since one join on either would compare every pair. What leads to a dashboard is found
    first, each node once; paths are then walked from the wanted tables and columns along such
    nodes only, so that every step belongs to a path that is shown.
    """
    pii = (
        assets.join(tags.filter(F.col("tag_name").startswith("PII")), "asset_id")
        .select(
            F.col("asset_id").alias("column_id"),
            F.col("parent_id").alias("table_id"),
            F.col("name").alias("column_name"),
            F.col("tag_value").alias("pii_type"),
        )
        .distinct()
    )
    certified = assets.filter((F.col("asset_type") == "TABLE") & (F.col("certification_status") == "CERTIFIED")).select(
        F.col("asset_id").alias("table_id"), F.col("name").alias("table_name"), "certification_status", "owner"
    )
    columns = checkpointed(certified.join(pii, "table_id"))
    dashboards = edges.filter(F.col("target").contains("dashboard")).select(F.col("target").alias("root")).distinct()
    reversed_edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    above = checkpointed(reachable(reversed_edges, dashboards))
    wanted = columns.select(F.col("table_id").alias("root")).unionAll(columns.select("column_id")).distinct()
    starts = wanted.join(above, F.col("root") == F.col("node"), "left_semi")
    targets_kept = dashboards.unionAll(above).toDF("target").distinct()
    walked = traverse(edges.join(targets_kept, "target", "left_semi"), starts, max_depth=max_depth)
    consumed = F.array_join(F.slice("path", 2, F.size("path") - 1), " -> ").alias("consumed_by_dashboard")
    sources = walked.join(dashboards.toDF("node"), "node", "left_semi").select(F.col("root").alias("node"), consumed)
    shown = ["table_name", "certification_status", "owner", "column_name", "pii_type", "consumed_by_dashboard"]
    by_table = columns.join(sources, F.col("table_id") == F.col("node")).select(*shown)
    by_column = columns.join(sources, F.col("column_id") == F.col("node")).select(*shown)
    return by_table.unionByName(by_column).distinct()


def accuracy(found: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict per target, totals) of found edges against verified sources.

    A verified source counts as found if an edge into the same target column comes from the
    same column of a table whose name contains the verified name, or the other way round.
    """
    listed = gold.select("target_table", "target_column", F.explode("expected_sources").alias("s")).select(
        "target_table", "target_column", F.lower("s.table").alias("_table"), F.lower("s.column").alias("_column")
    )
    parsed = found.select(
        "target_table",
        "target_column",
        F.lower("source_table").alias("_found"),
        F.lower("source_column").alias("_column"),
    ).distinct()
    alike = F.col("_found").contains(F.col("_table")) | F.col("_table").contains(F.col("_found"))
    per_source = (
        # sorted, so that no task holds a side of the join
        listed.join(parsed.hint("merge"), ["target_table", "target_column", "_column"], "left")
        .groupBy("target_table", "target_column", "_table", "_column")
        .agg(F.coalesce(F.bool_or(alike), F.lit(False)).alias("_hit"))
    )
    per_target = per_source.groupBy("target_table", "target_column").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(~F.col("_hit")).alias("missing"), F.bool_and("_hit").alias("correct")
    )
    total, right = F.count(F.lit(1)), F.count_if("correct")
    totals = per_target.agg(
        total.alias("total_hand_verified"),
        right.alias("correct"),
        (total - right).alias("failures_count"),
        ratio(right, total, 2, scale=100).alias("accuracy_percentage"),
    )
    return per_target, totals


def run_events(
    edges: DataFrame,
    namespace: str,
    event_time: str,
    producer: str,
) -> DataFrame:
    """COMPLETE run events with column lineage, as JSON: one per target table, as the event format asks."""
    field = F.struct(F.lit(namespace).alias("namespace"), F.col("source_table").alias("name"), F.col("source_column").alias("field"))
    by_column = edges.groupBy("target_table", "target_column").agg(
        F.array_sort(F.collect_set(field)).alias("inputFields"),
        F.min("transformation_type").alias("transformationType"),
        F.coalesce(F.min("expression"), F.min("transformation_type")).alias("transformationDescription"),
        F.collect_set("source_table").alias("_sources"),
    )
    entry = F.struct("target_column", F.struct("inputFields", "transformationDescription", "transformationType").alias("facet"))
    by_table = by_column.groupBy("target_table").agg(
        F.array_sort(F.collect_list(entry)).alias("_fields"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("_sources"),
    )
    dataset = F.transform("_sources", lambda s: F.struct(F.lit(namespace).alias("namespace"), s.alias("name")))
    facets = F.struct(F.struct(F.map_from_entries("_fields").alias("fields")).alias("columnLineage"))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        F.lit(event_time).alias("eventTime"),
        F.struct(stable_id("target_table").alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.concat(F.lit("model."), "target_table").alias("name")).alias("job"),
        dataset.alias("inputs"),
        F.array(F.struct(F.lit(namespace).alias("namespace"), F.col("target_table").alias("name"), facets.alias("facets"))).alias("outputs"),
        F.lit(producer).alias("producer"),
    )
    return by_table.select("target_table", F.to_json(event).alias("event"))
