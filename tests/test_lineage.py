from collections import deque
import random

import pytest
from pyspark.sql import functions as F

from tabellion.operators import lineage

EDGES = "source string, target string, transformation_type string, ordinal long"


def graph(spark, *edges):
    return spark.createDataFrame([(s, t, k, i) for i, (s, t, k) in enumerate(edges)], EDGES)


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_chain_both_ways(spark):
    edges = graph(spark, ("a", "b", "X"), ("b", "c", "X"), ("c", "d", "X"))
    down = {r.node: (r.depth, r.lineage_path) for r in lineage.downstream(edges, roots(spark, "a")).collect()}
    assert down["d"] == (3, "a -> b -> c -> d")
    up = {r.node: r.lineage_path for r in lineage.upstream(edges, roots(spark, "d")).collect()}
    assert up == {"c": "d <- c", "b": "d <- c <- b", "a": "d <- c <- b <- a"}
    assert lineage.downstream(edges, roots(spark, "a"), 2).count() == 2


def test_cycles_end(spark):
    edges = graph(spark, ("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"))
    assert lineage.downstream(edges, roots(spark, "a")).count() == 2
    assert {(r.node, r.depth) for r in lineage.closure(edges, roots(spark, "a")).collect()} == {("b", 1), ("c", 2)}


def test_propagation_example(spark):
    edges = graph(spark, ("raw.id", "stg.id", "DIRECT_COPY"), ("stg.id", "dim.id", "AGGREGATION"), ("dim.id", "mart.id", "DIRECT_COPY"))
    seeds = spark.createDataFrame([("raw.id", "PII", "CUSTOMER_ID", 1.0)], "root string, tag_name string, tag_value string, confidence double")
    rows = sorted(lineage.propagate(edges, seeds).collect(), key=lambda r: r.hop_count)
    assert [r.hop_count for r in rows] == [1, 2, 3] and [round(r.confidence, 5) for r in rows] == [0.98, 0.882, 0.86436]
    assert len(rows[2].reason_chain) == 4 and rows[0].reason_chain[0] == "raw.id [PII:CUSTOMER_ID]"


def breadth_first(edges, seeds, max_hops):
    outgoing = {}
    for s, t, kind, _ in edges:
        outgoing.setdefault(s, []).append((t, kind))
    found = []
    for seed in seeds:
        seen, queue = {seed}, deque([(seed, 1.0, 0, [f"{seed} [PII:X]"])])
        while queue:
            node, confidence, hops, chain = queue.popleft()
            if hops >= max_hops:
                continue
            for target, kind in outgoing.get(node, []):
                c, path = confidence * (0.98 if kind == "DIRECT_COPY" else 0.90), [*chain, f"{target} ({kind})"]
                found.append((seed, target, c, hops + 1, path))
                if target not in seen:
                    seen.add(target)
                    queue.append((target, c, hops + 1, path))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["DIRECT_COPY", "AGGREGATION"]), i) for i in range(160)]
    starts = ["n1", "n2", "n3"]
    frame = spark.createDataFrame(edges, EDGES)
    seeds = spark.createDataFrame([(s, "PII", "X", 1.0) for s in starts], "root string, tag_name string, tag_value string, confidence double")
    got = [(r.root, r.node, r.confidence, r.hop_count, r.reason_chain) for r in lineage.propagate(frame, seeds, 4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, breadth_first(edges, starts, 4)))


def test_roll_up_keeps_the_first_type_and_drops_self_edges(spark):
    edges = graph(spark, ("d.s.a.x", "d.s.b.x", "ONE"), ("d.s.a.y", "d.s.b.y", "TWO"), ("d.s.a.x", "d.s.a.y", "SELF"))
    assert [tuple(r) for r in lineage.roll_up(edges).collect()] == [("d.s.a", "d.s.b", "ONE")]


def test_dashboard_query_compares_no_pairs(spark):
    assets = spark.createDataFrame(
        [("e.p.t", "e", "TABLE", "t", "CERTIFIED", "o"), ("e.p.t.c", "e.p.t", "COLUMN", "c", "DRAFT", None), ("e.p.u", "e", "TABLE", "u", "DRAFT", "o")],
        "asset_id string, parent_id string, asset_type string, name string, certification_status string, owner string",
    )
    tags = spark.createDataFrame([("e.p.t.c", "PII", "EMAIL")], "asset_id string, tag_name string, tag_value string")
    edges = graph(spark, ("e.p.t", "e.p.u", "X"), ("e.p.u", "dashboard.x", "X"), ("e.p.t.c", "dashboard.y", "X"))
    found = lineage.certified_pii_consumption(assets, tags, edges)
    assert {(r.column_name, r.consumed_by_dashboard) for r in found.collect()} == {("c", "e.p.u -> dashboard.x"), ("c", "dashboard.y")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_table_gives_one_event_with_all_its_edges(spark):
    edges = spark.createDataFrame(
        [("s", f"c{i}", "t", f"d{i % 4}", "COMPUTED", None, i) for i in range(10)],
        "source_table string, source_column string, target_table string, target_column string, transformation_type string, expression string, position int",
    )
    events = lineage.run_events(edges, "n", "2024-01-01", "p")
    assert events.columns == ["target_table", "event"] and events.count() == 1
    fields = events.select(F.explode(F.from_json(F.get_json_object("event", "$.outputs[0].facets.columnLineage.fields"), "map<string, struct<inputFields: array<string>>>")).alias("c", "f"))
    assert fields.select(F.explode("f.inputFields")).count() == 10


def test_long_chains_reach_the_dashboard_and_carry_tags(spark):
    chain = [(f"t{i}" if i else "e.p.t0", f"t{i + 1}", "DIRECT_COPY") for i in range(14)] + [("t14", "dashboard.d", "DASHBOARD_CONSUMPTION")]
    edges = graph(spark, *chain, ("side", "t3", "X"), ("t2", "dead end", "X"))
    assets = spark.createDataFrame(
        [("e.p.t0", "TABLE", "t0", "CERTIFIED", "me", None), ("e.p.t0.c", "COLUMN", "c", None, None, "e.p.t0"), ("side", "TABLE", "side", "CERTIFIED", "me", None)],
        "asset_id string, asset_type string, name string, certification_status string, owner string, parent_id string",
    )
    tags = spark.createDataFrame([("e.p.t0.c", "PII", "EMAIL")], "asset_id string, tag_name string, tag_value string")
    rows = lineage.certified_pii_consumption(assets, tags, edges).collect()
    assert [(r.table_name, r.pii_type) for r in rows] == [("t0", "EMAIL")]
    assert rows[0].consumed_by_dashboard.split(" -> ") == [*[f"t{i}" for i in range(1, 15)], "dashboard.d"]
    seeds = spark.createDataFrame([("e.p.t0", "PII", "X", 1.0)], "root string, tag_name string, tag_value string, confidence double")
    assert lineage.propagate(edges, seeds).agg(F.max("hop_count")).first()[0] == 15
    assert {r.node for r in lineage.reachable(edges, roots(spark, "t12", "t13")).collect()} == {"t14", "dashboard.d"}


def test_accuracy_holds_no_side_of_its_join(spark):
    gold = spark.createDataFrame([("m", f"c{n}", [("s", f"c{n}"), ("t", "x")]) for n in range(20)], "target_table string, target_column string, expected_sources array<struct<table: string, column: string>>")
    found = spark.createDataFrame([("cte_s", f"C{n}", "m", f"c{n}") for n in range(19)] * 2, "source_table string, source_column string, target_table string, target_column string")
    verdicts, totals = lineage.accuracy(found, gold)
    got = {r.target_column: (r.expected, r.missing) for r in verdicts.collect()}
    assert got == {f"c{n}": (2, 1 if n < 19 else 2) for n in range(20)}
    assert "Broadcast" not in verdicts._jdf.queryExecution().executedPlan().toString() and totals.first().correct == 0


def test_tags_travel_as_numbers_and_chains_are_copied_once(spark, monkeypatch):
    kept, frames = lineage.checkpointed, []

    def recorded(df):
        frames.append(kept(df))
        return frames[-1]

    # the only edge into n0 and n1 closes a cycle; n5 is reached twice, n0 is a root of two tags, one without a value
    rows = [(f"n{i}", f"n{i + 1}", "DIRECT_COPY") for i in range(12)] + [("n12", "n0", "X"), ("n2", "n5", "X"), ("n2", "n5", "X"), ("n3", None, "X")]
    edges = [(s, t, k, i) for i, (s, t, k) in enumerate(rows)]
    seeds = spark.createDataFrame([("n0", "PII", "X", 1.0), ("n0", "PII", None, 0.5), ("n4", "PII", "X", 1.0), (None, "PII", "X", 1.0)], "root string, tag_name string, tag_value string, confidence double")
    monkeypatch.setattr(lineage, "checkpointed", recorded)
    found = lineage.propagate(spark.createDataFrame(edges, EDGES), seeds).collect()
    assert {dict(f.dtypes)["_tag"] for f in frames if "_tag" in f.columns} == {"bigint"}
    assert sum(f.count() for f in frames if "reason_chain" in f.columns) <= 2 * 3 * 13
    got = [(r.root, r.node, round(r.confidence, 9), r.hop_count, r.reason_chain) for r in found if r.tag_value]
    wanted = [(*r[:2], round(r[2], 9), *r[3:]) for r in breadth_first([e for e in edges if e[1]], ["n0", "n4"], 99)]
    assert sorted(map(str, [r for r in got if r[1]])) == sorted(map(str, wanted))
    assert len(found) - len(got) == sum(r[0] == "n0" for r in got) == 16
