"""Tamper-evident audit trail: hash chains per asset, cut into bounded segments, sealed by a tree.

A hash chain is sequential, so a chain over one busy asset would be the work of one task.
Each asset's trail is therefore cut into segments of ``segment_rows`` records. Segments are
hashed independently (in parallel, also within one asset), start from a digest of their
position, and their last hashes are sealed by a hash tree up to one root per asset, and these
up to one root of the estate. Changing, dropping or moving a record breaks its segment or the
row of record numbers; what is cut off at the end no longer leads to the seal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tabellion.functions.ordered import MAX_GROUP_ROWS, OrderedGroups
from tabellion.session import checkpointed

SEGMENT_ROWS = 1000
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def state_text(state: Column) -> Column:
    """Canonical text of a state map: its entries in key order."""
    entries = F.array_sort(F.map_entries(state))
    shown = F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null"))))
    return F.coalesce(F.array_join(shown, ","), F.lit(""))


def state_diff(before: Column, after: Column) -> Column:
    """Map of changed key -> (before, after), over the keys of ``after``; empty without a before state."""
    kept = F.map_filter(before, lambda k, _: F.array_contains(F.map_keys(after), k))
    pairs = F.map_zip_with(kept, after, lambda _, old, new: F.struct(old.alias("before"), new.alias("after")))
    return F.map_filter(pairs, lambda _, pair: ~pair["before"].eqNullSafe(pair["after"]))


def diff_text(before: Column, after: Column) -> Column:
    """Canonical text of the diff: changed keys of ``after`` in key order, or that the asset was created."""

    def old(entry: Column) -> Column:
        return F.try_element_at(before, entry["key"])

    changed = F.filter(F.array_sort(F.map_entries(after)), lambda x: ~old(x).eqNullSafe(x["value"]))
    shown = F.transform(
        changed,
        lambda x: F.concat(x["key"], F.lit(":"), F.coalesce(old(x), F.lit("null")), F.lit(">"), F.coalesce(x["value"], F.lit("null"))),
    )
    return F.when(before.isNull(), F.lit("created")).otherwise(F.array_join(shown, ","))


def record_body() -> Column:
    """Canonical text of a record without its place in the chain."""
    before, after = F.col("before_state"), F.col("after_state")
    return F.concat_ws(
        "|",
        F.date_format("event_time", TIME_FORMAT),
        "actor",
        F.col("asset_id").cast("string"),
        "action",
        F.array_join(F.array_sort("policy_ids_evaluated"), ","),
        diff_text(before, after),
        state_text(before),
        state_text(after),
    )


def segment_start(asset: Column, segment: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("segment"), asset.cast("string"), segment.cast("string")), 256)


def append(
    events: DataFrame,
    order: list[str],
    heads: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Audit records for ``events``, chained per asset in the given order.

    ``events`` needs asset_id, event_time, actor, action, policy_ids_evaluated (array) and the
    maps before_state and after_state. ``heads`` (asset_id, record_id, curr_hash: the last
    record per asset) continues existing chains.
    """
    numbered = OrderedGroups(events, ["asset_id"], order, max_group_rows).row_number("record_id")
    if heads is None:
        numbered = numbered.withColumns({"_last": F.lit(0).cast("bigint"), "_head": F.lit(None).cast("string")})
    else:
        last = heads.select("asset_id", F.col("record_id").alias("_last"), F.col("curr_hash").alias("_head"))
        numbered = numbered.join(last, "asset_id", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
        numbered = numbered.withColumn("record_id", F.col("record_id") + F.col("_last"))
    segment = F.floor((F.col("record_id") - 1) / segment_rows)
    continues = F.col("_last") > F.col("segment") * segment_rows
    start = F.when(continues, F.col("_head")).otherwise(segment_start(F.col("asset_id"), F.col("segment")))
    placed = numbered.withColumn("segment", segment).withColumn("_start", start)
    ready = placed.withColumn("_body", record_body())
    return _chained(ready, [c for c in ready.columns if not c.startswith("_")])


def _chained(ready: DataFrame, columns: list[str]) -> DataFrame:
    """Hashes each segment by a fold over its records (at most ``segment_rows``) in record order.

    Whole records travel through the segment's array, so nothing has to be joined back. Maps
    travel as entry arrays, because rows that are sorted may not hold maps.
    """
    maps = [f.name for f in ready.schema.fields if isinstance(f.dataType, T.MapType)]
    carried = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in columns if c != "record_id"]
    record = F.struct("record_id", "_start", "_body", *carried)
    segments = ready.groupBy("asset_id", "segment").agg(F.array_sort(F.collect_list(record)).alias("_records"))
    hashes = F.aggregate(
        "_records",
        F.array(F.col("_records")[0]["_start"]),
        lambda done, r: F.concat(done, F.array(_digest(r["record_id"], F.element_at(done, -1), r["_body"]))),
    )
    size = F.size("_records")
    linked = F.arrays_zip(
        F.col("_records").alias("r"),
        F.slice("_hashes", F.lit(1), size).alias("prev_hash"),
        F.slice("_hashes", F.lit(2), size).alias("curr_hash"),
    )
    listed = segments.withColumn("_hashes", hashes).select(F.inline(linked).alias("r", "prev_hash", "curr_hash"))
    fields = [F.map_from_entries(F.col(f"r.{c}")).alias(c) if c in maps else F.col(f"r.{c}").alias(c) for c in columns]
    return listed.select(*fields, "prev_hash", "curr_hash")


def _digest(record_id: Column, previous: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", record_id.cast("string"), previous, body), 256)


def verify(records: DataFrame, segment_rows: int = SEGMENT_ROWS, sealed: DataFrame | None = None) -> DataFrame:
    """The records that break the trail, with the reason; every segment is checked on its own.

    A record is broken if its hash does not follow from its contents, if it does not point at
    the record before it, or if a record is missing before it. What is missing before the
    first record of a segment shows in the segments' first and last numbers, of which there
    is one row per segment. Against ``sealed`` (asset_id, chain_length, root_hash) records
    missing at the end of an asset, or all of them, are found too, as the reason MISSING_TAIL
    of the last number that should be there.
    """
    segment = F.floor((F.col("record_id") - 1) / segment_rows)
    window = Window.partitionBy("asset_id", "_segment").orderBy("record_id")
    opening = F.col("_before").isNull()
    starts = (F.col("record_id") - 1) % segment_rows == 0
    expected = F.when(starts, segment_start(F.col("asset_id"), F.col("_segment"))).otherwise(F.col("_before"))
    recomputed = _digest(F.col("record_id"), F.col("prev_hash"), record_body())
    gap = F.when(opening, F.col("_gap")).otherwise(F.col("_id_before") != F.col("record_id") - 1)
    reason = (
        F.when(recomputed != F.col("curr_hash"), "CONTENT")
        .when(gap, "MISSING_RECORD")
        .when(~F.col("prev_hash").eqNullSafe(expected), "LINK")
    )
    along = Window.partitionBy("asset_id").orderBy("_segment")
    ends = records.groupBy("asset_id", segment.alias("_segment")).agg(
        F.min("record_id").alias("_least"), F.max("record_id").alias("_most")
    )
    gaps = ends.withColumn("_earlier", F.coalesce(F.lag("_most").over(along), F.lit(0))).select(
        F.col("asset_id").alias("_asset"), F.col("_least"), (F.col("_least") != F.col("_earlier") + 1).alias("_gap")
    )
    linked = records.withColumn("_segment", segment).withColumns(
        {"_before": F.lag("curr_hash").over(window), "_id_before": F.lag("record_id").over(window)}
    )
    first = (F.col("asset_id").eqNullSafe(F.col("_asset"))) & (F.col("record_id") == F.col("_least"))
    found = (
        linked.join(gaps.filter("_gap"), first, "left")
        .withColumn("_gap", F.coalesce("_gap", F.lit(False)))
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("asset_id", "record_id", "reason", "prev_hash", "curr_hash")
    )
    if sealed is None:
        return found
    last = ends.groupBy(F.col("asset_id").alias("_asset")).agg(F.max("_most").alias("_most"))
    tails = sealed.join(last, F.col("asset_id").eqNullSafe(F.col("_asset")), "left").filter(
        F.coalesce("_most", F.lit(0)) < F.col("chain_length")
    )
    none = F.lit(None).cast("string")
    return found.unionByName(
        tails.select(
            "asset_id",
            F.col("chain_length").alias("record_id"),
            F.lit("MISSING_TAIL").alias("reason"),
            none.alias("prev_hash"),
            none.alias("curr_hash"),
        )
    )


def heads(records: DataFrame) -> DataFrame:
    """Last record of each asset, where new records continue."""
    return records.groupBy("asset_id").agg(
        F.max("record_id").alias("record_id"), F.max_by("curr_hash", "record_id").alias("curr_hash")
    )


def seal(records: DataFrame, segment_rows: int = SEGMENT_ROWS, fan: int = 100) -> DataFrame:
    """One root per asset over its segment heads: a tree in which every node has at most ``fan`` children."""
    segment = F.floor((F.col("record_id") - 1) / segment_rows)
    heads_of = records.groupBy("asset_id", segment.alias("place")).agg(
        F.max_by("curr_hash", "record_id").alias("digest"), F.max("record_id").alias("last")
    )
    bottom = checkpointed(heads_of)
    level = bottom.select("asset_id", "place", "digest")
    widest = level.agg(F.max("place")).first()[0]
    while widest is not None and widest > 0:
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        level = (
            level.groupBy("asset_id", F.floor(F.col("place") / fan).alias("parent"))
            .agg(children.alias("children"))
            .select("asset_id", F.col("parent").alias("place"), F.sha2(F.array_join("children.digest", "|"), 256).alias("digest"))
        )
        widest //= fan
    sizes = bottom.groupBy("asset_id").agg(F.max("last").alias("chain_length"))
    return level.join(sizes, "asset_id").select("asset_id", "chain_length", F.col("digest").alias("root_hash"))


def verify_seal(records: DataFrame, sealed: DataFrame, segment_rows: int = SEGMENT_ROWS, fan: int = 100) -> DataFrame:
    """Assets whose trail no longer leads to the sealed root."""
    now = seal(records, segment_rows, fan).select("asset_id", F.col("root_hash").alias("_now"), F.col("chain_length").alias("_length"))
    now = now.withColumnRenamed("asset_id", "_asset")
    joined = sealed.join(now, F.col("asset_id").eqNullSafe(F.col("_asset")), "full_outer")
    return joined.filter(~F.col("root_hash").eqNullSafe(F.col("_now"))).select(
        F.coalesce("asset_id", "_asset").alias("asset_id"), "chain_length", F.col("_length").alias("found_length")
    )


def estate_root(sealed: DataFrame, digits: int = 4) -> DataFrame:
    """One root over the heads of all assets: assets are dealt to buckets by digest, buckets are hashed in order.

    ``digits`` hexadecimal digits give 16 ** digits buckets, folded by one digit per level,
    so that no level gathers more than a bucket of assets or 16 digests in one row.
    """
    leaf = F.sha2(F.concat_ws("|", F.col("asset_id").cast("string"), F.col("chain_length").cast("string"), "root_hash"), 256)
    place = F.substring(F.sha2(F.col("asset_id").cast("string"), 256), 1, digits)
    counts = [F.lit(1).cast("bigint").alias("assets"), F.col("chain_length").cast("bigint").alias("records")]
    level = sealed.select(place.alias("place"), leaf.alias("digest"), *counts)
    for depth in range(digits, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        level = (
            level.groupBy(F.substring("place", 1, depth).alias("parent"))
            .agg(children.alias("children"), F.sum("assets").alias("assets"), F.sum("records").alias("records"))
            .select(F.col("parent").alias("place"), F.sha2(F.array_join("children.digest", "|"), 256).alias("digest"), "assets", "records")
        )
    return level.select("assets", "records", F.col("digest").alias("estate_root"))


def summary(records: DataFrame, broken: DataFrame) -> DataFrame:
    """Length, validity and first and last hash per asset."""
    faults = broken.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_faults"))
    trails = records.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("chain_length"),
        F.min_by("curr_hash", "record_id").alias("first_hash"),
        F.max_by("curr_hash", "record_id").alias("last_hash"),
    )
    joined = trails.join(faults, "asset_id", "left")
    return joined.withColumn("is_valid", F.col("_faults").isNull()).drop("_faults")


def tail(records: DataFrame, rows: int = 30) -> DataFrame:
    """The newest records of the whole trail."""
    return records.orderBy(F.col("event_time").desc(), F.col("asset_id").desc(), F.col("record_id").desc()).limit(rows)
