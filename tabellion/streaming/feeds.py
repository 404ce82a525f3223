"""Streaming forms of the stateful operators, replayable to the end of their input.

Every function takes a streaming DataFrame. ``run_available`` processes what the source holds
and stops; with another trigger the same queries run continuously.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DataType, LongType, StructField, StructType

from tabellion.operators import approval, catalog, policy
from tabellion.operators.admission import decisions, micros
from tabellion.sources.changelog import ChangeLog

CLOSING_TIME = "9999-01-01 00:00:00"
CLOSING_MICROS = (dt.datetime(9999, 1, 1) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_feed(spark: SparkSession, folder: str, files: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files in a folder whose names match ``files``, typed like those already there."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(feed: DataFrame, path: str, mode: str = "append") -> None:
    """Writes everything the source holds to a Parquet table at ``path``."""
    query = (
        feed.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_end(feed: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Runs ``build(feed)`` over everything the source holds and then closes the feed.

    Rows that wait for the watermark would otherwise wait for good. After the first run a
    closing row with a time beyond all others is written to a control folder that ``build``
    reads together with the feed; the second run lets the watermark pass all real rows, so that
    what waits comes out. The closing row's other columns are null; it is behind the watermark
    itself and never comes out. What is fed after the end is late.
    """
    spark = feed.sparkSession
    control, name = f"{path}/control", feed.schema[time].dataType.simpleString()
    closing = spark.sql(f"SELECT CAST('{CLOSING_TIME}' AS {name}) AS `{time}`")
    if not ChangeLog(spark, path, "", "").exists(control):
        closing.limit(0).write.parquet(control)
    ends = spark.readStream.schema(closing.schema).parquet(control)
    both = feed.unionByName(ends, allowMissingColumns=True)
    run_available(build(both), path)
    closing.coalesce(1).write.mode("append").parquet(control)
    run_available(build(both), path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def routed_proposals(feed: DataFrame) -> DataFrame:
    """Proposals judged and routed as they arrive; stateless."""
    return approval.route(policy.evaluate(feed))


def hourly_quality(feed: DataFrame, time: str, checks: dict[str, str], late: str = "1 hour") -> DataFrame:
    """Rows and failing rows per hour; ``checks`` maps a name to the SQL condition of a bad row.

    Watermarks need zoned time, so event time is read in the session's zone (pinned to UTC).
    An hour is final, and in append mode emitted, once the watermark has passed it.
    """
    counted = [F.count_if(F.expr(condition)).alias(name) for name, condition in checks.items()]
    source = feed.withColumn("_event_time", F.col(time).cast("timestamp"))
    if feed.isStreaming:
        source = source.withWatermark("_event_time", late)
    hour = F.window("_event_time", "1 hour").alias("w")
    grouped = source.groupBy(hour).agg(F.count(F.lit(1)).alias("rows"), *counted)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "rows", *checks)


class Admission(StatefulProcessor):
    """Holds a client's requests until the watermark has passed them, then decides them in time order.

    The state is what still waits and the accepted times that still count, of which there
    are at most ``max_requests``. Requests behind the watermark come out at once, as late.
    """

    def __init__(self, client: str, order: str, order_type: DataType, max_requests: int, span: int):
        self.client = client
        self.order = order
        self.order_type = order_type
        self.max_requests = max_requests
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", StructType([StructField("at", LongType())]))
        waits = StructType([StructField("at", LongType()), StructField("place", self.order_type)])
        self.waiting = handle.getListState("waiting", waits)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first, out = None, []
        for batch in rows:
            batch = batch[batch["at_micros"] < CLOSING_MICROS]
            # before any batch there is no watermark
            behind = (batch["at_micros"] < watermark * 1000) & (watermark > 0)
            if behind.any():
                places = batch.loc[behind, self.order]
                out.append(self._rows(key, places.tolist(), [None] * len(places), True))
                batch = batch[~behind]
            if len(batch):
                self.waiting.appendList(list(zip(batch["at_micros"].tolist(), batch[self.order].tolist(), strict=True)))
                least = int(batch["at_micros"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        requests = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in requests if r[0] < passed], [r for r in requests if r[0] >= passed]
        counted = sorted(row[0] for row in self.recent.get()) if self.recent.exists() else []
        accepted, counted = decisions([at for at, _ in due], counted, self.max_requests, self.span)
        if counted:
            self.recent.put([(t,) for t in counted])
        elif self.recent.exists():
            self.recent.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif requests:
            self.waiting.clear()
        if not due:
            return iter(())
        return iter([self._rows(key, [place for _, place in due], accepted, False)])

    def _rows(self, key, places: list, accepted: list, late: bool) -> pd.DataFrame:
        verdicts = pd.array(accepted, dtype="boolean")
        return pd.DataFrame({self.client: [key[0]] * len(places), self.order: places, "accepted": verdicts, "late": late})

    def close(self) -> None:
        pass


def admitted(feed: DataFrame, client: str, time: str, order: str, max_requests: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """(client, order, accepted, late) for each request, decided once the watermark has passed it.

    However requests are spread over batches, the verdicts are those of ``admission.admit``
    over all requests in time. A request that comes after the watermark has passed it cannot be
    decided any more; it is a row with ``late`` set and no verdict. Requests without a time are
    left out. Needs the RocksDB state store; ``run_to_end`` also decides the last requests.
    """
    schema = f"`{client}` {feed.schema[client].dataType.simpleString()}, `{order}` {feed.schema[order].dataType.simpleString()}, accepted boolean, late boolean"
    processor = Admission(client, order, feed.schema[order].dataType, max_requests, window_seconds * 1_000_000)
    timed = feed.select(client, order, F.col(time).cast("timestamp").alias("event_time"), micros(time).alias("at_micros"))
    # without the time column the engine drops no late rows, so that the processor sees them
    timed = timed.where("event_time is not null").withWatermark("event_time", late).select(client, order, "at_micros")
    return timed.groupBy(client).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def asset_log(spark: SparkSession, path: str, **options: int) -> ChangeLog:
    """The change log of the catalog that ``versioned_changes`` keeps under ``path``."""
    return ChangeLog(spark, f"{path}/current", "asset_id", "version", **options)


def asset_schema(changes: StructType, time: str, fields: Sequence[str] = catalog.ASSET_FIELDS) -> StructType:
    """The columns of a current asset: asset_id, the fields that changes carry, version and both times."""
    known = [f for f in fields if f in changes.names]
    times = [StructField(name, changes[time].dataType) for name in ("created_at", "updated_at")]
    return StructType([changes["asset_id"], *[changes[f] for f in known], StructField("version", LongType()), *times])


def current_catalog(spark: SparkSession, path: str, changes: StructType, time: str, fields: Sequence[str] = catalog.ASSET_FIELDS) -> DataFrame:
    """The catalog after all finished batches; ``changes`` is the schema of the feed."""
    return asset_log(spark, path).read(asset_schema(changes, time, fields))


def versioned_changes(
    feed: DataFrame, order: Sequence[str], time: str, path: str, fields: Sequence[str] = catalog.ASSET_FIELDS, **options: int
) -> StreamingQuery:
    """Folds a feed of asset changes into versioned history, batch by batch.

    Each batch writes its own history folder and, into the change log of the catalog, the rows
    of the assets it changed; it reads only the buckets of those. A repeated batch overwrites
    its own output and nothing else. Versions are numbered by (time, id) inside a batch;
    published versions are never rewritten. ``options`` go to the change log.
    """
    schema = asset_schema(feed.schema, time, fields)

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = asset_log(spark, path, **options)
        parts = log.parts(before=number)
        base = log.read(schema, parts, log.touched(batch.select("asset_id"))).join(batch.select("asset_id").distinct(), "asset_id", "left_semi")
        history = catalog.asset_history(batch, list(order), fields, base if parts else None)
        history.write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        written = spark.read.schema(history.schema).parquet(f"{path}/history/batch={number}")
        latest = catalog.current_assets(written, time, fields)
        born = base.select("asset_id", F.col("created_at").alias("_born"))
        latest = latest.join(born, "asset_id", "left").withColumn("created_at", F.coalesce("_born", "created_at"))
        log.append(latest.select(*[F.col(f.name).cast(f.dataType) for f in schema]), number)

    return _each_batch(feed, fold, f"{path}/progress")


def _each_batch(feed: DataFrame, work: Callable[[DataFrame, int], None], progress: str) -> StreamingQuery:
    return feed.writeStream.foreachBatch(work).option("checkpointLocation", progress).trigger(availableNow=True).start()
