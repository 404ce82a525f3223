import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabellion.operators import audit, proofs

SEG, FAN = 3, 2
SCHEMA = (
    "asset_id string, id int, event_time timestamp_ntz, actor string, action string, policy_ids_evaluated array<string>, "
    "before_state map<string,string>, after_state map<string,string>"
)


def events(spark, counts, start=0):
    at = dt.datetime(2024, 1, 1)
    rows = [(a, i, at + dt.timedelta(minutes=i), f"w{i % 3}", "SET", ["P"], None, {"v": str(i)}) for a, n in counts.items() for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def appended(spark, steps):
    """Records, the last step's records, nodes and seals after appending step by step."""
    records, nodes, seals, start = None, None, [], 0
    for counts in steps:
        new = audit.append(events(spark, counts, start), ["id"], None if records is None else audit.heads(records), SEG)
        new = new.cache()
        more = proofs.grow(new, nodes, SEG, FAN)
        records = new if records is None else records.unionByName(new)
        nodes = more if nodes is None else nodes.unionByName(more)
        nodes = nodes.cache()
        seals.append(proofs.sealed_roots(nodes).cache())
        start += 100
    return records, new, nodes, seals


@pytest.fixture(scope="module")
def grown(spark):
    return appended(spark, [{"a": 7, "b": 1, "c": 3, None: 4}, {"a": 1, "b": 2}, {"a": 20, "d": 5, "c": 1}])


def found(frame):
    return {(r.asset_id, r.reason) for r in frame.collect()}


def test_a_grown_tree_equals_one_made_at_once(spark, grown):
    records, _, nodes, seals = grown
    whole = proofs.sealed_roots(proofs.grow(records, None, SEG, FAN))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seals[-1].collect()))
    assert {r.asset_id: r.chain_length for r in seals[-1].collect()} == {"a": 28, "b": 3, "c": 4, "d": 5, None: 4}


def test_every_earlier_root_can_be_built_again(spark, grown):
    _, _, nodes, seals = grown
    for seal in seals:
        again = proofs.roots(proofs._heads_at(nodes, seal, SEG), nodes, SEG, FAN)
        assert sorted(map(str, again.select(seal.columns).collect())) == sorted(map(str, seal.collect()))


def test_honest_growth_is_accepted(spark, grown):
    _, new, nodes, seals = grown
    assert found(proofs.verify_growth(new, nodes, seals[1], seals[2], SEG, FAN)) == set()


def test_changes_are_found(spark, grown):
    _, new, nodes, seals = grown

    def problems(records=new, stored=nodes, before=seals[1], after=seals[2]):
        return found(proofs.verify_growth(records, stored, before, after, SEG, FAN))

    changed = new.withColumn("actor", F.when(F.col("id") == 205, "nobody").otherwise(F.col("actor")))
    assert problems(changed) >= {("a", "CONTENT"), ("d", "CONTENT")} or ("a", "CONTENT") in problems(changed)
    assert ("a", "MISSING_RECORD") in problems(new.where("asset_id <> 'a' or id <> 200"))
    assert ("a", "NEW_ROOT") in problems(new.where("asset_id <> 'a' or id < 219"))
    # an old leaf that was changed with its ancestors left alone, or an old seal that is not of this tree
    old = nodes.withColumn("digest", F.when((F.col("asset_id") == "a") & (F.col("level") == 0) & (F.col("place") == 2), "x").otherwise(F.col("digest")))
    assert ("a", "OLD_ROOT") in problems(stored=old)
    forged = seals[1].withColumn("root_hash", F.when(F.col("asset_id") == "b", "x").otherwise(F.col("root_hash")))
    assert problems(before=forged) >= {("b", "OLD_ROOT")}
    assert ("b", "NEW_ROOT") in problems(after=seals[2].withColumn("root_hash", F.when(F.col("asset_id") == "b", "x").otherwise(F.col("root_hash"))))
    assert (None, "OLD_ROOT") in problems(before=seals[1].withColumn("root_hash", F.when(F.col("asset_id").isNull(), "x").otherwise(F.col("root_hash"))))


def test_a_changed_old_record_is_found_in_its_segment(spark, grown):
    records, _, nodes, seals = grown
    segment = F.floor((F.col("record_id") - 1) / SEG)
    some = records.where((F.col("asset_id") == "a") & segment.isin(1, 4) | (F.col("asset_id") == "b"))
    assert found(proofs.verify_segments(some, nodes, seals[-1], SEG, FAN)) == set()
    changed = some.withColumn("actor", F.when(F.col("record_id") == 5, "nobody").otherwise(F.col("actor")))
    assert found(proofs.verify_segments(changed, nodes, seals[-1], SEG, FAN)) == {("a", "CONTENT")}
    # rewritten so that the segment is consistent in itself
    body = F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.col("prev_hash"), audit.record_body()), 256)
    forged = some.withColumn("actor", F.when(F.col("record_id") == 6, "nobody").otherwise(F.col("actor")))
    forged = forged.withColumn("curr_hash", F.when(F.col("record_id") == 6, body).otherwise(F.col("curr_hash")))
    assert ("a", "INCLUSION") in found(proofs.verify_segments(forged, nodes, seals[-1], SEG, FAN))


def test_the_trail_is_hashed_once_for_all_checks(spark, monkeypatch, tmp_path):
    import __spark_entry__ as entry

    rows = [(n, dt.datetime(2024, 1, 1, 0, n % 50, n % 7), n % 3, ("view", "error")[n % 2], n / 4, f'{{"k": {n % 9}}}') for n in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    calls, append = [], audit.append
    monkeypatch.setattr(audit, "append", lambda *a, **k: calls.append(1) or append(*a, **k))
    for name in ("audit_verify_tampered", "audit_verify_seal"):
        found = entry.queries()[name](spark, str(tmp_path))
        assert len(calls) == 1 and "Scan parquet" not in found._jdf.queryExecution().executedPlan().toString()
        if name == "audit_verify_tampered":  # events 7 and 9 are changed, 11 is dropped before 14
            assert sorted(r.reason for r in found.collect()) == ["CONTENT", "CONTENT", "MISSING_RECORD"]
        calls.clear()
