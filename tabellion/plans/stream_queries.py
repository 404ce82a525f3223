"""Streaming queries, run to the end of the test tables and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabellion.plans.binding import Estate
from tabellion.plans.catalog_queries import asset_changes
from tabellion.plans.evaluate_queries import ADMISSION_SQL
from tabellion.plans.policy_queries import STATUS_COLUMNS, proposals
from tabellion.plans.registry import query
from tabellion.session import scratch_path
from tabellion.streaming import feeds

CHECKS = {"low_value": "value < 1.0", "errors": "event_type = 'error'", "blank_props": "props IS NULL"}
HOURLY = """SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS rows, COUNT(*) FILTER (WHERE value < 1.0) AS low_value, COUNT(*) FILTER (WHERE event_type = 'error') AS errors,
    CAST(0 AS BIGINT) AS blank_props FROM events GROUP BY ALL"""


class Feed(Estate):
    """The estate with its tables read as streams."""

    def table(self, name: str) -> DataFrame:
        return feeds.read_feed(self.spark, self.folder, f"{name}.parquet")


def stream(e: Estate) -> Feed:
    return Feed(e.spark, e.folder)


@query("quality_hourly", HOURLY)
def quality_hourly(e: Estate) -> DataFrame:
    return feeds.hourly_quality(e.table("events"), "ts", CHECKS)


@query("stream_quality_hourly", HOURLY)
def stream_quality_hourly(e: Estate) -> DataFrame:
    """All hours of the feed; the open ones come out when the feed is closed."""
    path = scratch_path(e.spark, "hourly")
    feeds.run_to_end(stream(e).table("events"), "ts", lambda feed: feeds.hourly_quality(feed, "ts", CHECKS), path)
    return feeds.stored(e.spark, path)


@query("stream_policy_routing", f"SELECT {', '.join(STATUS_COLUMNS)} FROM routed_t")
def stream_policy_routing(e: Estate) -> DataFrame:
    path = scratch_path(e.spark, "routing")
    feeds.run_available(feeds.routed_proposals(proposals(stream(e))).select(*STATUS_COLUMNS), path)
    return feeds.stored(e.spark, path)


STREAM_CURRENT = """SELECT asset_id, description, owner, certification_status, quality_score, version FROM asset_states_t QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY version DESC) = 1"""


@query("stream_asset_current", STREAM_CURRENT)
def stream_asset_current(e: Estate) -> DataFrame:
    path = scratch_path(e.spark, "changes")
    feed = asset_changes(stream(e))
    feeds.versioned_changes(feed, ["ts", "event_id"], "ts", path).awaitTermination()
    return feeds.current_catalog(e.spark, path, feed.schema, "ts").drop("created_at", "updated_at")


def asset_feed(e: Estate, files: int) -> tuple[str, DataFrame]:
    """The asset changes as files in time order, and a stream that reads one file a batch."""
    folder = scratch_path(e.spark, "change-files")
    changes = asset_changes(e)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = changes.agg(F.min(seconds), F.max(seconds)).first()
    part = F.least(F.floor((seconds - first) * files / (last - first + 1)), F.lit(files - 1))
    for i in range(files):
        changes.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return folder, feeds.read_feed(e.spark, folder, "*.parquet", files_per_batch=1)


@query("stream_asset_current_batches", STREAM_CURRENT)
def stream_asset_current_batches(e: Estate) -> DataFrame:
    """The same catalog from five batches, folded into its change log one after another."""
    _, feed = asset_feed(e, 5)
    path = scratch_path(e.spark, "changes")
    feeds.versioned_changes(feed, ["ts", "event_id"], "ts", path, buckets=16).awaitTermination()
    return feeds.current_catalog(e.spark, path, feed.schema, "ts").drop("created_at", "updated_at")


def with_rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    """Runs with the state store that list states and timers need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, feeds.ROCKSDB)
    try:
        run()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


@query("stream_admission_control", ADMISSION_SQL)
def stream_admission_control(e: Estate) -> DataFrame:
    """A verdict on every request; the last ones are decided when the feed is closed."""
    path = scratch_path(e.spark, "admission")
    with_rocksdb(
        e.spark,
        lambda: feeds.run_to_end(
            stream(e).table("events"), "ts", lambda feed: feeds.admitted(feed, "user_id", "ts", "event_id", 3, 86_400), path
        ),
    )
    return feeds.stored(e.spark, path).select("user_id", "event_id", "accepted")
