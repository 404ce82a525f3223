import random
from collections import Counter

import pytest

from tabellion.operators import lineage, paths

EDGES = "source string, target string, transformation_type string"


def plain(edges, roots, upstream=False, max_depth=None):
    """Every simple path, one by one."""
    outgoing = {}
    for s, t, kind in set(edges):
        if s is not None and t is not None:
            a, b = (t, s) if upstream else (s, t)
            outgoing.setdefault(a, []).append((b, kind))
    counts, shortest, lasts = Counter(), {}, Counter()

    def walk(root, path):
        if max_depth is not None and len(path) > max_depth:
            return
        for node, kind in outgoing.get(path[-1], []):
            if node not in path:
                counts[root, node] += 1
                shortest[root, node] = min(shortest.get((root, node), len(path)), len(path))
                lasts[root, path[-1], node, kind] += 1
                walk(root, [*path, node])

    for root in set(roots):
        walk(root, [root])
    return {(r, n, c, shortest[r, n]) for (r, n), c in counts.items()}, {(*k, c) for k, c in lasts.items()}


def graph(seed, nodes=24, count=46):
    rng = random.Random(seed)
    edges = [(f"n{a}", f"n{b}", rng.choice("XY")) for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count))]
    # mostly forward, so that there are few and small cycles
    edges = [(a, b, k) if int(a[1:]) <= int(b[1:]) or rng.random() < 0.12 else (b, a, k) for a, b, k in edges]
    return edges + edges[:5] + [("n1", "n1", "X"), ("lone", None, "X"), ("p", "q", "X"), ("q", "p", "Y"), ("q", "p", "X")]


@pytest.mark.parametrize("seed", [1, 3])
def test_counts_and_predecessors_equal_listed_paths(spark, seed):
    edges = graph(seed)
    index = paths.PathIndex(spark.createDataFrame(edges, EDGES))
    names = ["n0", "n1", "n5", "n9", "p", "unknown", "n0"]
    roots = spark.createDataFrame([(n,) for n in names], "root string")
    for upstream in (False, True):
        counts, lasts = plain(edges, names, upstream)
        found = index.paths_from(roots, upstream)
        assert {(r.root, r.node, int(r.paths), r.shortest) for r in found.counts().collect()} == counts
        assert {(*r[:4], int(r.paths)) for r in found.last_edges().collect()} == lasts
        near = index.paths_from(roots, upstream, 2).counts().collect()
        assert {(r.root, r.node, int(r.paths), r.shortest) for r in near} == plain(edges, names, upstream, 2)[0]


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a"), ("g", "g")]
    found = paths.strong_components(spark.createDataFrame(edges, "source string, target string"))
    assert {tuple(r) for r in found.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e")}


def test_a_ladder_of_forty_diamonds_ends(spark):
    edges = []
    for i in range(40):
        for side in "uv":
            edges += [(f"d{i:02}", f"{side}{i:02}", "X"), (f"{side}{i:02}", f"d{i + 1:02}", "X")]
    found = paths.both_ways(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("d00",)], "root string")).collect()
    assert [(r.direction, r.nodes) for r in found] == [("DOWNSTREAM", 120)]
    assert int(found[0].paths) == sum(2 * 2**i + 2 ** (i + 1) for i in range(40))


def test_empty_edges_and_roots(spark):
    none = spark.createDataFrame([], EDGES)
    roots = spark.createDataFrame([("a",), (None,)], "root string")
    assert paths.both_ways(none, roots).collect() == []
    some = spark.createDataFrame([("a", "b", "X")], EDGES)
    assert paths.PathIndex(some).paths_from(roots.limit(0)).counts().collect() == []
    assert [tuple(r)[:2] for r in paths.PathIndex(some).paths_from(roots).counts().collect()] == [("a", "b")]


def test_same_paths_as_the_listing(spark):
    edges = graph(7)
    frame = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], f"{EDGES}, ordinal long")
    roots = spark.createDataFrame([("n0",), ("n3",)], "root string")
    listed = lineage.traverse(frame, roots).groupBy("root", "node").count()
    counted = paths.PathIndex(frame).paths_from(roots).counts()
    assert {tuple(r) for r in listed.collect()} == {(r.root, r.node, int(r.paths)) for r in counted.collect()}


def test_layers_are_joined_without_the_driver(spark, monkeypatch):
    """A broadcast in every layer sends the whole graph to the driver again and again; partitions must not add up either."""
    plans, widths, kept = [], [], paths.checkpointed

    def recorded(df):
        done = kept(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        widths.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(paths, "checkpointed", recorded)
    rows = [(f"n{(i - 1) // 2}", f"n{i}", "DIRECT_COPY") for i in range(1, 64)]
    edges = spark.createDataFrame(rows, "source string, target string, transformation_type string")
    roots = edges.select("source").distinct().toDF("root")
    counts = {(r.root, r.node): (int(r.paths), r.shortest) for r in paths.PathIndex(edges).paths_from(roots).counts().collect()}
    assert counts["n0", "n63"] == (1, 6) and len(counts) == sum(d * 2**d for d in range(1, 6)) + 6
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert max(widths) <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), edges.rdd.getNumPartitions())


def test_pairs_that_feed_each_other_need_no_search_for_components(spark, monkeypatch):
    chain = [(f"c{i}", f"c{i + 1}", "X") for i in range(8)] + [("c3", "c2", "Y"), ("c6", "c5", "Y"), ("p", "q", "X"), ("q", "p", "X")]
    # a pair inside a larger cycle
    larger = [("a", "b", "X"), ("b", "a", "X"), ("b", "d", "X"), ("d", "a", "Y"), ("c8", "a", "X"), ("d", "end", "X")]
    searched, search = [], paths.strong_components
    monkeypatch.setattr(paths, "strong_components", lambda pairs: searched.append(pairs) or search(pairs))
    starts = ["c0", "c3", "b", "p", "end"]
    roots = spark.createDataFrame([(n,) for n in starts], "root string")
    for edges, upstream, searches in ((chain, True, 0), (chain + larger, False, 1)):
        found = paths.PathIndex(spark.createDataFrame(edges, EDGES)).paths_from(roots, upstream)
        assert len(searched) == searches
        counts, lasts = plain(edges, starts, upstream)
        assert {(r.root, r.node, int(r.paths), r.shortest) for r in found.counts().collect()} == counts
        assert {(*r[:4], int(r.paths)) for r in found.last_edges().collect()} == lasts
