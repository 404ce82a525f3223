import datetime as dt
import random

from pyspark.sql import functions as F

from tabellion.operators import admission, approval, catalog, policy
from tabellion.plans.stream_queries import with_rocksdb
from tabellion.sources.changelog import ChangeLog
from tabellion.streaming import feeds
from test_evaluate import requests

FIELDS = "asset_id string, ts timestamp_ntz, id int, description string, owner string, quality_score double"


def split_into_files(spark, df, time, path, parts=3):
    """Files in time order, so that a stream reads them as consecutive batches."""
    rows = df.orderBy(time, "id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(path))


def test_changes_in_batches_equal_one_fold(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"a{i % 4}", start + dt.timedelta(minutes=i), i, None if i % 3 else f"d{i}", None if i % 2 else f"o{i}", None if i % 5 else i / 4) for i in range(40)]
    df = spark.createDataFrame(rows, FIELDS)
    split_into_files(spark, df, "ts", tmp_path / "in")
    feed = feeds.read_feed(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    feeds.versioned_changes(feed, ["ts", "id"], "ts", str(tmp_path / "out")).awaitTermination()
    whole = catalog.asset_history(df, ["ts", "id"])
    got = spark.read.parquet(str(tmp_path / "out" / "history")).select(whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    current = feeds.current_catalog(spark, str(tmp_path / "out"), feed.schema, "ts")
    wanted = catalog.current_assets(whole, "ts")
    assert sorted(map(str, current.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_admission_in_batches_equals_batch(spark, tmp_path):
    """Requests in random order over three batches, then one long after that lets the watermark pass them all."""
    rows = requests(300, 8)
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id int")
    mixed = random.Random(4).sample(rows, len(rows))
    last = ("end", max(r[1] for r in rows) + dt.timedelta(days=90), 10_000)
    for part in (mixed[:100], mixed[100:200], mixed[200:], [last]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = feeds.read_feed(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    run = lambda: feeds.run_available(feeds.admitted(feed, "client", "ts", "id", 4, 30, late="30 days"), str(tmp_path / "out"))
    with_rocksdb(spark, run)
    found = feeds.stored(spark, str(tmp_path / "out")).collect()
    assert not any(r.late for r in found)
    assert {r.id: r.accepted for r in found} == {r.id: r.accepted for r in admission.admit(df, "client", "ts", "id", 4, 30).collect()}


def test_a_closed_feed_decides_every_request_and_shows_the_late_ones(spark, tmp_path):
    """Two batches in time order, then requests from before the watermark among new ones; no request lets the watermark pass the last."""
    rows = requests(240, 9)
    rows = sorted(rows, key=lambda r: r[1])
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id int")
    early = [("x", rows[0][1], 1001), ("y", rows[1][1], 1002)]
    for part in (rows[:120], rows[120:200], early + rows[200:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = feeds.read_feed(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    build = lambda f: feeds.admitted(f, "client", "ts", "id", 4, 30, late="0 seconds")
    with_rocksdb(spark, lambda: feeds.run_to_end(feed, "ts", build, str(tmp_path / "out")))
    found = feeds.stored(spark, str(tmp_path / "out")).collect()
    assert len(found) == len(rows) + 2
    assert {(r.id, r.accepted) for r in found if r.late} == {(1001, None), (1002, None)}
    assert {r.id: r.accepted for r in found if not r.late} == {r.id: r.accepted for r in admission.admit(df, "client", "ts", "id", 4, 30).collect()}


def test_routing_and_hourly_quality(spark, tmp_path):
    proposals = spark.range(40).selectExpr("id AS proposal_id", "id % 3 = 0 AS is_pii", "'EMAIL' AS pii_type", "id / 40 AS confidence", "concat('a', id) AS asset_id")
    proposals.write.parquet(str(tmp_path / "p"))
    feed = feeds.read_feed(spark, str(tmp_path / "p"), "*.parquet")
    feeds.run_available(feeds.routed_proposals(feed).select("proposal_id", "status"), str(tmp_path / "routed"))
    wanted = approval.route(policy.evaluate(proposals)).select("proposal_id", "status")
    assert sorted(map(str, feeds.stored(spark, str(tmp_path / "routed")).collect())) == sorted(map(str, wanted.collect()))

    readings = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i, float(i % 5)) for i in range(100)], "ts timestamp_ntz, id int, v double"
    )
    split_into_files(spark, readings, "ts", tmp_path / "r")
    checks = {"zero": "v = 0"}
    feed = feeds.read_feed(spark, str(tmp_path / "r"), "*.parquet", files_per_batch=1)
    feeds.run_available(feeds.hourly_quality(feed, "ts", checks), str(tmp_path / "hours"))
    last = readings.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    wanted = feeds.hourly_quality(readings, "ts", checks).filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    assert sorted(map(str, feeds.stored(spark, str(tmp_path / "hours")).collect())) == sorted(map(str, wanted.collect()))
    feeds.run_to_end(feed, "ts", lambda f: feeds.hourly_quality(f, "ts", checks), str(tmp_path / "closed"))
    every = feeds.hourly_quality(readings, "ts", checks)
    assert sorted(map(str, feeds.stored(spark, str(tmp_path / "closed")).collect())) == sorted(map(str, every.collect()))


ASSETS = "asset_id string, owner string, version long"


def assets(spark, ids, version):
    return spark.createDataFrame([(f"a{i}", f"o{version}", version) for i in ids], ASSETS)


def content(log, schema):
    return {r.asset_id: (r.owner, r.version) for r in log.read(schema).collect()}


def test_a_change_log_writes_what_changed(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "asset_id", "version", buckets=4)
    first = assets(spark, range(400), 1)
    log.append(first, 0)
    written = []
    wanted = {f"a{i}": ("o1", 1) for i in range(400)}
    for batch in range(1, 9):
        changed = [batch, batch + 100, 500 + batch]
        written.append(sum(p.rows for p in log.append(assets(spark, changed, batch + 1), batch)))
        wanted.update({f"a{i}": (f"o{batch + 1}", batch + 1) for i in changed})
        assert content(log, first.schema) == wanted
    assert max(written) == 3
    assert content(log, first.schema) == wanted


def test_repeated_batches_compaction_and_vacuum(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "asset_id", "version", buckets=2, most_deltas=3)
    wanted = {}
    for batch in range(7):
        rows = assets(spark, range(batch, batch + 6), batch + 1)
        wanted.update({f"a{i}": (f"o{batch + 1}", batch + 1) for i in range(batch, batch + 6)})
        once = log.append(rows, batch)
        assert log.append(rows, batch) == once
        assert content(log, rows.schema) == wanted
    assert any(p.kind == "full" for p in log.parts())
    gone = log.vacuum()
    assert gone and content(log, rows.schema) == wanted
    assert log.append(rows, 6) == once and content(log, rows.schema) == wanted
    log.append(rows.limit(0), 7)
    assert content(log, rows.schema) == wanted
    some = log.touched(rows.where("asset_id = 'a6'"))
    assert {r.asset_id for r in log.read(rows.schema, buckets=some).collect()} <= set(wanted)
    empty = ChangeLog(spark, str(tmp_path / "none"), "asset_id", "version")
    assert empty.parts() == [] and empty.read(rows.schema).count() == 0 and empty.vacuum() == []
