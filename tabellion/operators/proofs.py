"""Stored hash trees over audit trails, with proofs that a trail has grown and not changed.

The leaves of an asset's tree are the heads of its segments; a node hashes its children, and
the tree is as high as its own asset needs, so that a root depends on nothing else. A node is
stored whenever it changes, with the number of the last record below it. Appending records adds
the new leaves and the nodes on the way to the root; a node whose segments are full never
changes. Any root of the past can therefore be built again from ``fan`` nodes a level.

``verify_growth`` reads the new records and, per asset, a logarithm of nodes; ``verify_segments``
proves records of any segments against a sealed root in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.operators import audit
from tabellion.session import checkpointed

FAN = 100
NODE = ["asset_id", "level", "place", "last", "digest"]
_KEY = "_key"


def _key() -> Column:
    """The asset as text that is never null, as joins are by equality."""
    return F.coalesce(F.concat(F.lit("="), F.col("asset_id").cast("string")), F.lit("")).alias(_KEY)


def _hash(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("node|"), F.array_join(children["digest"], "|")), 256)


def _segment(segment_rows: int, record: str = "record_id") -> Column:
    return F.floor((F.col(record) - 1) / segment_rows)


def leaves(records: DataFrame, segment_rows: int = audit.SEGMENT_ROWS) -> DataFrame:
    """The head of every segment that has one of ``records``: its last hash and number."""
    return records.groupBy("asset_id", _segment(segment_rows).alias("place")).agg(
        F.max("record_id").alias("last"), F.max_by("curr_hash", "record_id").alias("digest")
    ).select("asset_id", F.lit(0).alias("level"), "place", "last", "digest")


def grow(records: DataFrame, nodes: DataFrame | None = None, segment_rows: int = audit.SEGMENT_ROWS, fan: int = FAN) -> DataFrame:
    """The nodes that ``records`` add to a tree: changed leaves and everything above them.

    ``records`` continue the trails that ``nodes`` stand for; of those only siblings of changed
    nodes are read. The result is to be kept beside ``nodes``.
    """
    changed = checkpointed(leaves(records, segment_rows).select(_key(), *NODE))
    old = None if nodes is None else nodes.select(_key(), *NODE)
    levels, level = [changed], 0
    while True:
        # records are appended, so the highest place of an asset is among its changed ones
        tall = changed.groupBy(_KEY).agg(F.max("place").alias("_top")).where("_top > 0").select(_KEY)
        climbing = changed.join(tall, _KEY, "left_semi").withColumn("_parent", F.floor(F.col("place") / fan))
        children = climbing
        if old is not None:
            parents = climbing.select(_KEY, "_parent").distinct()
            kept = old.where(F.col("level") == level).withColumn("_parent", F.floor(F.col("place") / fan)).join(parents, [_KEY, "_parent"], "left_semi")
            both = kept.unionByName(climbing)
            newest = F.max_by(F.struct("asset_id", "last", "digest"), "last").alias("n")
            children = both.groupBy(_KEY, "_parent", "place").agg(newest).select(_KEY, "_parent", "place", "n.*")
        level += 1
        above = children.groupBy(_KEY, "_parent").agg(
            F.first("asset_id").alias("asset_id"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("_children")
        )
        changed = checkpointed(
            above.select(_KEY, "asset_id", F.lit(level).alias("level"), F.col("_parent").alias("place"), "last", _hash(F.col("_children")).alias("digest"))
        )
        if changed.isEmpty():
            break
        levels.append(changed)
    return reduce(DataFrame.unionByName, levels).select(*NODE)


def sealed_roots(nodes: DataFrame) -> DataFrame:
    """(asset_id, chain_length, root_hash) of the trails as they are now: the newest of an asset's highest nodes."""
    top = F.max_by(F.struct("last", "digest"), F.struct("level", "last")).alias("t")
    found = nodes.select(_key(), *NODE).groupBy(_KEY).agg(F.first("asset_id").alias("asset_id"), top)
    return found.select("asset_id", F.col("t.last").alias("chain_length"), F.col("t.digest").alias("root_hash"))


def roots(starts: DataFrame, nodes: DataFrame, segment_rows: int = audit.SEGMENT_ROWS, fan: int = FAN) -> DataFrame:
    """The root that each leaf of ``starts`` leads to, in the tree as it was at a length.

    ``starts``: asset_id, chain_length, place and digest of a leaf. Adds root_hash to
    (asset_id, chain_length, place). Beside the leaf only its siblings and those of the
    nodes above it are read, at most ``fan`` a level.
    """
    shelf = nodes.select(_key(), *NODE)
    now = starts.select(
        _key(), "asset_id", "chain_length", F.col("place").alias("_leaf"), "place", "digest", _segment(segment_rows, "chain_length").alias("_most")
    )
    now, level, done = checkpointed(now), 0, []
    while True:
        done.append(now.where("_most <= 0").select("asset_id", "chain_length", F.col("_leaf").alias("place"), F.col("digest").alias("root_hash")))
        climbing = now.where("_most > 0").withColumn("_parent", F.floor(F.col("place") / fan))
        if climbing.isEmpty():
            break
        kids = shelf.where(F.col("level") == level).select(
            _KEY, F.floor(F.col("place") / fan).alias("_parent"), F.col("place").alias("_place"), "last", F.col("digest").alias("_digest")
        )
        beside = climbing.join(kids, [_KEY, "_parent"]).where(F.col("last") <= F.col("chain_length"))
        rest = [_KEY, "asset_id", "chain_length", "_leaf", "place", "digest", "_most", "_parent"]
        as_of = beside.groupBy(*rest, "_place").agg(F.max_by("_digest", "last").alias("_digest"))
        known = F.when(F.col("_place") == F.col("place"), F.col("digest")).otherwise(F.col("_digest"))
        kept = F.array_sort(F.collect_list(F.struct(F.col("_place").alias("place"), known.alias("digest"))))
        above = as_of.groupBy(*rest).agg(kept.alias("_children"))
        now = checkpointed(
            above.select(
                _KEY, "asset_id", "chain_length", "_leaf", F.col("_parent").alias("place"), _hash(F.col("_children")).alias("digest"),
                F.floor(F.col("_most") / fan).alias("_most"),
            )
        )
        level += 1
    return reduce(DataFrame.unionAll, done)


def _heads_at(nodes: DataFrame, seals: DataFrame, segment_rows: int) -> DataFrame:
    """The leaf that holds the last record of each seal, as it was then."""
    wanted = seals.select(_key(), "asset_id", "chain_length", _segment(segment_rows, "chain_length").alias("place"))
    leaf = nodes.select(_key(), *NODE).where("level = 0").select(_KEY, "place", "last", "digest")
    at = wanted.join(leaf, [_KEY, "place"]).where(F.col("last") == F.col("chain_length"))
    return at.select("asset_id", "chain_length", "place", "digest").distinct()


def _wrong(seals: DataFrame, found: DataFrame, reason: str) -> DataFrame:
    """Seals that are not among the roots found."""
    built = found.select(_key(), F.col("chain_length").alias("_length"), F.col("root_hash").alias("_found"))
    joined = seals.select(_key(), "asset_id", "chain_length", "root_hash").join(built, _KEY, "left")
    good = F.coalesce((F.col("_found") == F.col("root_hash")) & (F.col("_length") == F.col("chain_length")), F.lit(False))
    return joined.where(~good).select("asset_id", F.col("chain_length").alias("record_id"), F.lit(reason).alias("reason")).distinct()


def verify_growth(
    new_records: DataFrame,
    nodes: DataFrame,
    before: DataFrame,
    after: DataFrame,
    segment_rows: int = audit.SEGMENT_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """(asset_id, record_id, reason) of what speaks against ``new_records`` being all that was added.

    ``before`` and ``after`` are seals (asset_id, chain_length, root_hash); ``nodes`` the stored
    tree. OLD_ROOT: the nodes no longer build the earlier seal. NEW_ROOT: grown by the new records
    they do not build the later one, so something old was changed as well, or something new. CONTENT, LINK, MISSING_RECORD: a new record does not follow from its contents
    or from the one before; the first one must follow the sealed head. Old records are not read.
    """
    was = _heads_at(nodes, before, segment_rows)
    problems = [_wrong(before, roots(was, nodes, segment_rows, fan), "OLD_ROOT")]
    lengths = before.select(_key(), "chain_length")
    old = nodes.select(_key(), *NODE).join(lengths, _KEY).where(F.col("last") <= F.col("chain_length")).select(*NODE)
    now = sealed_roots(grow(new_records, old, segment_rows, fan))
    # assets without new records must have kept their seal
    grown = new_records.select(_key()).distinct()
    same = before.select(_key(), "*").join(grown, _KEY, "left_anti").select("asset_id", "chain_length", "root_hash")
    problems.append(_wrong(after, now.unionByName(same), "NEW_ROOT"))
    problems.append(_new_records(new_records, was, before, segment_rows))
    return reduce(DataFrame.unionByName, problems).distinct()


def _new_records(records: DataFrame, was: DataFrame, before: DataFrame, segment_rows: int) -> DataFrame:
    """Breaks inside the new records, whose first ones follow the sealed heads."""
    head = was.select(_key(), F.col("digest").alias("_head"))
    lengths = before.select(_key(), F.col("chain_length").alias("_length")).join(head, _KEY, "left")
    placed = records.select(_key(), "*").join(lengths, _KEY, "left").withColumn("_length", F.coalesce("_length", F.lit(0)))
    first = F.col("record_id") == F.col("_length") + 1
    opens = (F.col("record_id") - 1) % segment_rows == 0
    start = F.when(opens, audit.segment_start(F.col("asset_id"), _segment(segment_rows))).otherwise(F.col("_head"))
    loose = placed.where(first & ~F.col("prev_hash").eqNullSafe(start)).select("asset_id", "record_id", F.lit("LINK").alias("reason"))
    begun = placed.groupBy(_KEY, "asset_id", "_length").agg(F.min("record_id").alias("record_id"))
    missing = begun.where(F.col("record_id") != F.col("_length") + 1).select("asset_id", "record_id", F.lit("MISSING_RECORD").alias("reason"))
    # the trail's own check, without the records that follow older ones: those are tested above
    inner = audit.verify(records, segment_rows).select("asset_id", "record_id", "reason")
    firsts = begun.select(_KEY, "record_id")
    told = inner.select(_key(), "*").join(firsts.withColumn("_first", F.lit(True)), [_KEY, "record_id"], "left")
    kept = told.where(F.col("_first").isNull() | (F.col("reason") == "CONTENT")).select("asset_id", "record_id", "reason")
    return loose.unionByName(missing).unionByName(kept)


def verify_segments(
    records: DataFrame, nodes: DataFrame, seals: DataFrame, segment_rows: int = audit.SEGMENT_ROWS, fan: int = FAN
) -> DataFrame:
    """(asset_id, record_id, reason) of what is wrong with ``records``, whole segments of sealed trails.

    The records must follow from their contents and each other (CONTENT, LINK, MISSING_RECORD), and their
    segments' heads must lead to the seals (INCLUSION). No other record is read.
    """
    own = leaves(records, segment_rows).select(_key(), "asset_id", "place", "digest", "last")
    starts = own.join(seals.select(_key(), "chain_length"), _KEY).select("asset_id", "chain_length", "place", "digest")
    found = roots(starts, nodes, segment_rows, fan).select(_key(), "asset_id", "chain_length", "place", "root_hash")
    wanted = seals.select(_key(), F.col("root_hash").alias("_sealed"))
    outside = found.join(wanted, _KEY).where(F.col("root_hash") != F.col("_sealed")).select(
        "asset_id", F.least((F.col("place") + 1) * segment_rows, "chain_length").alias("record_id"), F.lit("INCLUSION").alias("reason")
    )
    inner = audit.verify(records, segment_rows).select("asset_id", "record_id", "reason")
    # segments may be picked freely: what is missing before their first record is no gap
    opening = (F.col("reason") == "MISSING_RECORD") & ((F.col("record_id") - 1) % segment_rows == 0)
    return outside.unionByName(inner.where(~opening))
