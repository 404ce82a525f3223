"""Counting paths of a lineage graph without listing them.

A simple path enters and leaves a cycle's strong component once, so paths are counted along the
order of the components, with one row per (root, node) however many paths there are. Paths are
listed only inside strong components, which in lineage are a few columns that feed each other.

``PathIndex`` holds, built once per edge table: the strong components, the layer of each node
(every edge between components leads to a higher layer), the paths inside components and the
edges between them. Roots are data: all are counted together, one join per layer with the edges
of that layer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabellion.operators.lineage import Levels, checkpoint_levels, narrowed, traverse
from tabellion.session import checkpointed, scratch_path

#: numbers of paths: exact up to 38 digits
WAYS = "decimal(38,0)"
#: layers counted from the end go down from here
LAST = 1 << 40


def peeled(pairs: DataFrame, first: int = 0, last: int = LAST) -> tuple[DataFrame, DataFrame, int]:
    """(layers, rest, rounds) of the graph ``pairs`` (source, target), which has no self-edges.

    Nodes without a predecessor and nodes without a successor are taken off together, round by
    round, so that what is left shrinks fast whether the graph spreads out or runs together. The
    former get the layers ``first``, ``first`` + 1 and so on, the latter ``last``, ``last`` - 1 and so
    on, a node that is left alone in between the layer after the former: every edge leads to a
    higher layer. ``rest`` are the edges among nodes on cycles or between cycles; it is empty for
    an acyclic graph.
    """
    rest, rounds, layers = pairs, 0, Levels()
    while True:
        sides = rest.select(F.col("source").alias("node"), F.lit(False).alias("_into"), F.lit(True).alias("_out")).unionAll(
            rest.select("target", F.lit(True), F.lit(False))
        )
        kinds = sides.groupBy("node").agg(F.bool_or("_into").alias("_into"), F.bool_or("_out").alias("_out")).where("not (_into and _out)")
        layer = F.when(F.col("_out"), F.lit(first + rounds)).otherwise(F.lit(last - rounds)).cast("bigint")
        gone = checkpointed(kinds.select("node", layer.alias("layer")))
        if gone.isEmpty():
            break
        layers.add(gone)
        for end in ("source", "target"):
            rest = rest.join(gone.select(F.col("node").alias(end)).hint("merge"), end, "left_anti")
        rest, rounds = checkpointed(rest.select("source", "target")), rounds + 1
    if not rounds:
        return pairs.select(F.col("source").alias("node"), F.lit(first).cast("bigint").alias("layer")).limit(0), rest, 0
    named = layers.union()
    kept = named.select("node").unionAll(rest.select("source")).unionAll(rest.select("target")).distinct()
    alone = _ends(pairs).join(kept.hint("merge"), "node", "left_anti")
    return checkpointed(narrowed(named.unionAll(alone.select("node", F.lit(first + rounds).cast("bigint"))))), rest, rounds


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("source").alias("node")).unionAll(pairs.select("target")).distinct()


def _merged(column: str, frame: DataFrame, members: DataFrame) -> DataFrame:
    """``frame`` with ``_column``, the component of ``column``, or itself if it is in none."""
    renamed = members.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
    return frame.join(renamed.hint("merge"), column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))


def _condensed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    between = _merged("target", _merged("source", pairs, members), members).where("_source <> _target")
    return checkpointed(between.select(F.col("_source").alias("source"), F.col("_target").alias("target")).distinct())


def _mutual(pairs: DataFrame) -> DataFrame:
    """(node, component) of nodes with edges both ways between them, and of chains of such nodes; the component is the largest."""
    back = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return _coloured(checkpointed(pairs.join(back.hint("merge"), ["source", "target"], "left_semi")))


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of ``pairs`` (source, target); the component is its largest node.

    Edges that cannot lie on a cycle are trimmed. The largest node that reaches a node is its
    colour; the nodes of one colour that reach the node of that name back are one component.
    Components are taken out and the rest is coloured again.
    """
    rest = checkpointed(pairs.where("source <> target").distinct())
    done: list[DataFrame] = []
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        colours = _coloured(rest)
        same = checkpointed(
            rest.join(colours.toDF("source", "_from"), "source").join(colours.toDF("target", "_to"), "target").where("_from = _to")
            .select("source", "target", F.col("_from").alias("component"))
        )
        found = checkpointed(colours.where("node = component"))
        frontier, parts = found, [found]
        while True:
            back = frontier.join(same.withColumnRenamed("target", "node"), ["node", "component"]).select(F.col("source").alias("node"), "component")
            frontier = checkpointed(back.distinct().join(reduce(DataFrame.unionAll, parts), ["node", "component"], "left_anti"))
            if frontier.isEmpty():
                break
            parts = checkpoint_levels([*parts, frontier])
        found = reduce(DataFrame.unionAll, parts)
        done.append(found)
        gone = found.select("node")
        rest = checkpointed(
            rest.join(gone, F.col("source") == F.col("node"), "left_anti").join(gone, F.col("target") == F.col("node"), "left_anti")
        )
    if not done:
        return pairs.select(F.col("source").alias("node"), F.col("target").alias("component")).limit(0)
    every = reduce(DataFrame.unionAll, done)
    sizes = every.groupBy("component").count().where("count > 1").select("component")
    return checkpointed(every.join(sizes, "component", "left_semi").select("node", "component"))


def _trimmed(rest: DataFrame) -> DataFrame:
    count = rest.count()
    while count:
        into = rest.select(F.col("target").alias("source")).distinct()
        out = rest.select(F.col("source").alias("target")).distinct()
        rest = checkpointed(rest.join(into.hint("merge"), "source", "left_semi").join(out.hint("merge"), "target", "left_semi").select("source", "target"))
        left = rest.count()
        if left == count:
            break
        count = left
    return rest


def _coloured(pairs: DataFrame) -> DataFrame:
    """(node, component): the largest node that leads to each node, itself included."""
    colours = checkpointed(_ends(pairs).withColumn("component", F.col("node")))
    changed = colours
    while not changed.isEmpty():
        sent = pairs.join(changed, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.max("component").alias("_new"))
        better = sent.join(colours, "node").where("_new > component").select("node", F.col("_new").alias("component"))
        changed = checkpointed(better)
        colours = checkpointed(colours.unionAll(changed).groupBy("node").agg(F.max("component").alias("component")))
    return colours


def in_order(df: DataFrame, column: str, *then: str) -> DataFrame:
    """``df`` written in the order of ``column``, so that a filter on it reads little more than its rows."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "in-order")
    df.repartitionByRange(column, *then).sortWithinPartitions(column, *then).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class PathIndex:
    """What path counting needs of an edge table (source, target, transformation_type), whatever the roots.

    Edges with null ends are left out; repeated edges of one type count once, edges of several types
    between two nodes are several paths, an edge from a node to itself is on none.
    """

    def __init__(self, edges: DataFrame):
        typed = edges.select("source", "target", "transformation_type").where("source <> target").distinct()
        self.edges = checkpointed(typed)
        pairs = checkpointed(self.edges.groupBy("source", "target").agg(F.count(F.lit(1)).cast(WAYS).alias("ways")))
        # most cycles are two columns that feed each other; without these the graph is often acyclic
        members = _mutual(pairs.select("source", "target"))
        whole = members.isEmpty()
        layers, rest, rounds = peeled(pairs.select("source", "target") if whole else _condensed(pairs, members))
        if not rest.isEmpty():
            larger = strong_components(rest)
            # the rest lies between the layers taken off at either end
            above, _, _ = peeled(_condensed(rest, larger), rounds, LAST - rounds)
            named = _merged("node", _ends(rest), larger)
            later = named.join(above.toDF("_node", "layer").hint("merge"), "_node", "left").select(
                "node", F.coalesce("layer", F.lit(rounds)).cast("bigint").alias("layer")
            )
            layers = checkpointed(narrowed(layers.unionAll(later)))
            if whole:
                members = larger
            else:
                own = _merged("component", members, larger).select("node", F.col("_component").alias("component"))
                members = checkpointed(own.unionAll(larger.join(members.select("node").hint("merge"), "node", "left_anti").select("node", "component")))
        elif whole:
            self.members, self.layers, self.inner, self.between = None, layers, None, pairs
            return
        self.members = members

        def merged(column: str, frame: DataFrame) -> DataFrame:
            return _merged(column, frame, members)

        placed = merged("node", _ends(pairs)).join(layers.toDF("_node", "_layer").hint("merge"), "_node", "left")
        # a component without edges out of it or into it is in no layer
        self.layers = checkpointed(placed.select("node", F.coalesce("_layer", F.lit(0)).cast("bigint").alias("layer")))
        both = merged("target", merged("source", self.edges))
        own = checkpointed(both.where("_source = _target").select("source", "target", "transformation_type"))
        starts = self.members.select(F.col("node").alias("root"))
        self.inner = checkpointed(traverse(own, starts).select("root", "node", "depth", F.element_at("path", -2).alias("_last"), "transformation_type"))
        self.between = checkpointed(merged("target", merged("source", pairs)).where("_source <> _target").select("source", "target", "ways"))

    def paths_from(self, roots: DataFrame, upstream: bool = False, max_depth: int | None = None) -> Paths:
        """The paths from (or, ``upstream``, to) every root (column ``root``), of at most ``max_depth`` edges if given."""
        return Paths(self, roots, upstream, max_depth)


class Paths:
    """Numbers of simple paths from many roots, in one pass over the layers.

    With a depth limit the pass goes by depth instead, so that lengths are known.
    """

    def __init__(self, index: PathIndex, roots: DataFrame, upstream: bool, max_depth: int | None):
        self.index, self.upstream, self.max_depth = index, upstream, max_depth
        near, far = ("target", "source") if upstream else ("source", "target")
        self.near, self.far = near, far
        links = index.between.select(F.col(near).alias("at"), F.col(far).alias("to"), "ways")
        inner = self._inner()
        if inner is not None:
            ways = inner.groupBy("_near", "_node", "_depth").agg(F.count(F.lit(1)).cast(WAYS).alias("_ways"))
            self.inside = checkpointed(ways)
            through = self.inside.join(links, F.col("_node") == F.col("at")).select(
                F.col("_near").alias("at"), "to", (F.col("_ways") * F.col("ways")).cast(WAYS).alias("ways"), (F.col("_depth") + 1).alias("length")
            )
            jumps = links.withColumn("length", F.lit(1).cast("bigint")).unionByName(through)
        else:
            self.inside = None
            jumps = links.withColumn("length", F.lit(1).cast("bigint"))
        place = index.layers.withColumn("step", -F.col("layer") if upstream else F.col("layer")).select("node", "step")
        by_layer = max_depth is None
        if by_layer:
            jumps = jumps.join(place.withColumnRenamed("node", "to").hint("merge"), "to").join(place.toDF("at", "_at_step").hint("merge"), "at")
            # a layer reads its own edges only
            jumps = in_order(jumps, "_at_step", "at")
        else:
            jumps = checkpointed(jumps)
        start = roots.select("root").where("root is not null").distinct().withColumn("node", F.col("root"))
        start = start.withColumns({"ways": F.lit(1).cast(WAYS), "depth": F.lit(0).cast("bigint")})
        start = start.join(place.hint("merge"), "node") if by_layer else start.withColumn("step", F.lit(0).cast("bigint"))
        start = in_order(start.select("root", "node", "step", "ways", "depth"), "step", "root")
        due = sorted(row.step for row in start.select("step").distinct().collect())
        waiting, step = None, due[0] if due else None
        arrived = Levels()
        while step is not None:
            here = start.where(F.col("step") == step)
            if waiting is not None:
                came = waiting.where(F.col("step") == step)
                here = here.unionByName(came) if step in due else came
                # not added up: ``waiting`` is kept, and whoever reads ``arrived`` adds up
                arrived.add(came.select("root", "node", "ways", "depth"))
            keys = ["root", "node"] if by_layer else ["root", "node", "depth"]
            sums = [F.sum("ways").cast(WAYS).alias("_before")] + ([F.min("depth").alias("depth")] if by_layer else [])
            now = here.groupBy(*keys).agg(*sums)
            depth = F.col("depth") + F.col("length")
            edges = jumps.where(F.col("_at_step") == step) if by_layer else jumps
            moved = now.join(edges.hint("merge"), F.col("node") == F.col("at")).select(
                "root", F.col("to").alias("node"), (F.col("step") if by_layer else depth).alias("step"),
                (F.col("_before") * F.col("ways")).cast(WAYS).alias("ways"), depth.alias("depth"),
            )
            if max_depth is not None:
                moved = moved.where(F.col("depth") <= max_depth)
            if waiting is not None:
                moved = waiting.where(F.col("step") > step).unionByName(moved)
            waiting = checkpointed(narrowed(moved))
            later = [waiting.agg(F.min("step")).first()[0], next((d for d in due if d > step), None)]
            step = min((s for s in later if s is not None), default=None)
        self.arrived = reduce(DataFrame.unionAll, [start.select("root", "node", "ways", "depth"), *arrived.frames()])

    def _inner(self) -> DataFrame | None:
        inner = self.index.inner
        if inner is None:
            return None
        near, at = ("node", "root") if self.upstream else ("root", "node")
        return inner.select(F.col(near).alias("_near"), F.col(at).alias("_node"), F.col("depth").alias("_depth"))

    def counts(self) -> DataFrame:
        """(root, node, paths, shortest): numbers of simple paths to every reached node, and the length of the shortest."""
        reached = self.arrived
        if self.inside is not None:
            on = reached.withColumnRenamed("node", "_near").join(self.inside, "_near").select(
                "root", F.col("_node").alias("node"), (F.col("ways") * F.col("_ways")).cast(WAYS).alias("ways"), (F.col("depth") + F.col("_depth")).alias("depth")
            )
            reached = reached.unionByName(on)
        if self.max_depth is not None:
            reached = reached.where(F.col("depth") <= self.max_depth)
        return reached.where("node <> root").groupBy("root", "node").agg(
            F.sum("ways").cast(WAYS).alias("paths"), F.min("depth").alias("shortest")
        )

    def last_edges(self) -> DataFrame:
        """(root, previous, node, transformation_type, paths): the edges that paths end in, and how many do.

        This is the predecessor graph: going back from a node along its rows spells every path
        between components out, and ``paths`` says how many there are before any is listed.
        Only for paths without a depth limit.
        """
        if self.max_depth is not None:
            raise ValueError("the predecessor graph has no depth limit")
        ends = self.counts().select("root", F.col("node").alias("previous"), "paths")
        start = self.arrived.where("node = root").select("root", F.col("root").alias("previous"), F.lit(1).cast(WAYS).alias("paths"))
        typed = self.index.edges.select(F.col(self.near).alias("previous"), F.col(self.far).alias("node"), "transformation_type")
        if self.index.members is not None:
            own = self.index.members
            ours = own.select(F.col("node").alias("previous"), F.col("component").alias("_a"))
            theirs = own.select("node", F.col("component").alias("_b"))
            typed = typed.join(ours, "previous", "left").join(theirs, "node", "left").where("_a is null or _b is null or _a <> _b")
        rows = ends.unionByName(start).join(typed.hint("merge"), "previous").where("node <> root").select("root", "previous", "node", "transformation_type", "paths")
        if self.index.inner is not None:
            rows = rows.unionByName(self._inside_edges())
        return rows.groupBy("root", "previous", "node", "transformation_type").agg(F.sum("paths").cast(WAYS).alias("paths"))

    def _inside_edges(self) -> DataFrame:
        """Ends of paths inside components. Upstream these are paths of the reversed edges, so they are walked again."""
        inner = self.index.inner
        if self.upstream:
            members = self.index.members
            own = self.index.edges.join(members.toDF("source", "_a"), "source").join(members.toDF("target", "_b"), "target").where("_a = _b")
            walked = traverse(own, members.select(F.col("node").alias("root")), upstream=True)
            inner = walked.select("root", "node", F.element_at("path", -2).alias("_last"), "transformation_type")
        steps = inner.groupBy("root", "_last", "node", "transformation_type").agg(F.count(F.lit(1)).cast(WAYS).alias("_ways"))
        entered = self.arrived.select(F.col("root").alias("_root"), F.col("node").alias("root"), "ways")
        return steps.join(entered, "root").select(
            F.col("_root").alias("root"), F.col("_last").alias("previous"), "node", "transformation_type",
            (F.col("_ways") * F.col("ways")).cast(WAYS).alias("paths"),
        )


def both_ways(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, direction, paths, nodes): number of upstream and downstream paths and nodes per root."""
    index = PathIndex(edges)
    sides = []
    for direction, upstream in (("UPSTREAM", True), ("DOWNSTREAM", False)):
        counts = index.paths_from(roots, upstream, max_depth).counts()
        per_root = counts.groupBy("root").agg(F.sum("paths").cast(WAYS).alias("paths"), F.count(F.lit(1)).alias("nodes"))
        sides.append(per_root.select("root", F.lit(direction).alias("direction"), "paths", "nodes"))
    return sides[0].unionAll(sides[1])
