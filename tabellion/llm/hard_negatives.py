"""Hard negatives by best-first search in an R-tree that is packed sort-tile-recursively.

Vectors are packed into shards: rows are cut into slabs along the coordinate of the largest
spread, slabs into shards along the second one (both by Spark's range partitioning), and the
rows of a shard into leaves along the next ones. Shards, inner nodes and leaves carry minimum
bounding boxes; a box bounds the inner product with an anchor coordinate by coordinate. A
queue visits boxes in the order of the upper bound and leaves out those that lie outside all
score windows or strictly below the k-th score found. Anchors go through the index in blocks
of neighbours: first the shards beside them, whose k-th scores then prune the other shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabellion.llm.common import written

#: vectors that the order of the coordinates is taken from, at most (the index holds all)
SAMPLE_ROWS = 20_000
#: rows of a shard: at least, at most; between them a table has SHARDS of them
LEAST_ROWS, MOST_ROWS, SHARDS = 256, 65_536, 64
#: neighbouring shards whose anchors are searched together, shards on a page of the directory
NEIGHBOURS, PAGE = 4, 256
LEAF_ROWS, FANOUT = 128, 8
SCALE = 256
#: sums of products below this are exact in double precision
EXACT = 2.0**53
LIMIT = 2**63 - 1

_FOUND = "query long, top long, id long, score long"
_BLOCK = "block long, ids binary, labels binary, kind string, vectors binary, width long"
_SHARD = (
    "shard long, ids binary, labels binary, kind string, vectors binary, width long, low array<double>, "
    "high array<double>, queries binary"
)


def quantised(embedding: Column) -> Column:
    """floor(256 x) of every component x as a whole number."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(embedding: Column, label: Column) -> Column:
    """Whether label, vector and components are there and all components are finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & finite, F.lit(False))


def _bytes(vectors: np.ndarray) -> tuple[str, bytes]:
    small = not vectors.size or (vectors.min() >= -32768 and vectors.max() <= 32767)
    kind = "int16" if small else "int64"
    return kind, vectors.astype(kind).tobytes()


def _vectors(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(-1, row["width"]).astype(np.int64)


def packed(vectors: np.ndarray, coordinates: np.ndarray, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """The order of the rows, sort-tile-recursive along ``coordinates``; each leaf is a run of ``leaf_rows``."""

    def tiles(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf_rows)
        if leaves <= 1 or depth == len(coordinates):
            return [rows]
        rows = rows[np.argsort(vectors[rows, coordinates[depth]], kind="stable")]
        if depth == len(coordinates) - 1:
            return [rows]
        slabs = max(2, round(leaves ** (1.0 / (len(coordinates) - depth))))
        step = -(-leaves // slabs) * leaf_rows
        return [tile for i in range(0, len(rows), step) for tile in tiles(rows[i : i + step], depth + 1)]

    return np.concatenate(tiles(np.arange(len(vectors)), 0)) if len(vectors) else np.arange(0)


class Tree:
    """A packed R-tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0.0))
        starts = np.arange(0, len(ids), LEAF_ROWS)
        low, high = np.minimum.reduceat(vectors, starts, axis=0), np.maximum.reduceat(vectors, starts, axis=0)
        self.levels = [(low.astype(np.float64), high.astype(np.float64))]
        while len(self.levels[-1][0]) > FANOUT:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)))
        self.exact = self.vectors.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and largest inner product of every query with every box."""
        return [interval(queries, low, high) for low, high in self.levels]

    def scores(self, query: np.ndarray, first: int, last: int) -> np.ndarray:
        """Inner products of the rows of a leaf; whole numbers of any size are added exactly, then cut to 64 bits."""
        if self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < EXACT:
            return (self.exact[first:last] @ query.astype(np.float64)).astype(np.int64)
        sums = self.vectors[first:last].astype(object) @ query.astype(object)
        return np.array([max(-LIMIT, min(LIMIT, int(s))) for s in sums], dtype=np.int64)

    def search(
        self,
        query: np.ndarray,
        label: int,
        windows: list[tuple[int, int]],
        floors: list[int],
        count: int,
        same: bool,
        bounds: list[tuple[np.ndarray, np.ndarray]],
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, largest score) the first ``count`` (scores, ids) of the rows with the same or another label.

        Higher scores come first, then smaller ids. ``floors`` are k-th scores that are known
        already: rows strictly below them are not wanted. ``bounds`` are this query's, by level.
        """
        none = np.zeros(0, dtype=np.int64)
        found = [(none, none) for _ in windows]
        least = [max(low, floor) for (low, _), floor in zip(windows, floors, strict=True)]
        most = max(high for _, high in windows)

        def wanted(low: float, high: float) -> bool:
            return any(high >= at and low <= top for at, (_, top) in zip(least, windows, strict=True))

        queue: list[tuple[float, int, int]] = []

        def offer(level: int, nodes: range) -> None:
            low, high = bounds[level]
            for node in nodes:
                if wanted(low[node], high[node]):
                    heapq.heappush(queue, (-min(high[node], float(most)), level, node))

        offer(len(bounds) - 1, range(len(bounds[-1][0])))
        while queue:
            _, level, node = heapq.heappop(queue)
            if not wanted(bounds[level][0][node], bounds[level][1][node]):
                continue  # the k-th scores have risen since
            if level:
                offer(level - 1, range(node * FANOUT, min((node + 1) * FANOUT, len(bounds[level - 1][0]))))
                continue
            first, last = node * LEAF_ROWS, min((node + 1) * LEAF_ROWS, len(self.ids))
            scores = self.scores(query, first, last)
            fits = (self.labels[first:last] == label) == same
            for j, (_, top) in enumerate(windows):
                keep = np.flatnonzero(fits & (scores >= least[j]) & (scores <= top))
                if not len(keep):
                    continue
                values = np.concatenate([found[j][0], scores[keep]])
                ids = np.concatenate([found[j][1], self.ids[first:last][keep]])
                best = np.lexsort((ids, -values))[:count]
                found[j] = (values[best], ids[best])
                if len(best) == count:
                    least[j] = max(least[j], int(values[best[-1]]))
        return found


def interval(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with a point of each box.

    Where sums may be inexact in double precision the intervals are widened.
    """
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < EXACT / 4, 0.0, size * 1e-12)
    edge = 2.0**63 - 1024  # scores are cut to 64 bits as well
    return np.minimum(least - slack, edge), np.maximum(most + slack, -edge)


def index(rows: DataFrame, width: int) -> DataFrame:
    """Shards of ``rows`` (id, label, vector, query): packed rows, boxes and the ids of the rows that are queries.

    Vectors are padded with zeros to ``width``. Every task packs its rows in pieces of at most
    MOST_ROWS, so that its memory is bounded whatever the ranges hold.
    """
    spark = rows.sparkSession
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector"))
    rows = rows.withColumn("vector", F.concat("vector", zeros))
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vector", "label"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    values = sample.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.float64)
    order = np.argsort(-values.var(axis=0), kind="stable") if len(values) else np.arange(width)
    per_shard = max(LEAST_ROWS, min(MOST_ROWS, count // SHARDS))
    shards = max(1, -(-count // per_shard))
    slabs = max(1, round(shards**0.5))
    first, second = (F.element_at("vector", int(order[min(i, width - 1)]) + 1) if width else F.lit(0) for i in (0, 1))
    cuts = rows.select(first.alias("c")).agg(F.percentile_approx("c", [i / slabs for i in range(1, slabs)], 10_000)).first()
    slab = F.lit(0)
    for cut in (cuts[0] or []) if slabs > 1 else []:
        slab = slab + (first > cut).cast("int")
    rows = rows.select("*", slab.alias("_slab"), second.alias("_second"))
    ranged = rows.repartitionByRange(shards, "_slab", "_second", "id").drop("_slab", "_second")
    inner = order[2:6]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= per_shard:
                yield piece(held, number)
                held, number = [], number + 1
        if any(b.num_rows for b in held):
            yield piece(held, number)

    def piece(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        vectors = part.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        asked = part.column("query").to_numpy(zero_copy_only=False).astype(bool)
        at = packed(vectors, inner)
        ids, labels, vectors, asked = ids[at], labels[at], vectors[at], asked[at]
        kind, data = _bytes(vectors)
        row = {
            "shard": number, "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "kind": kind,
            "vectors": data, "width": width, "low": vectors.min(axis=0).astype(float).tolist(),
            "high": vectors.max(axis=0).astype(float).tolist(), "queries": np.flatnonzero(asked).astype(np.int64).tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_arrow(_SHARD))

    made = written(ranged.mapInArrow(shard, _SHARD), "rtree-pieces")
    # numbers without gaps; the rows of this table are shards
    numbers = {n: i for i, n in enumerate(sorted(r[0] for r in made.select("shard").collect()))}
    if not numbers:
        return made
    pairs = spark.createDataFrame(list(numbers.items()), "shard long, number long")
    return written(made.join(F.broadcast(pairs), "shard").drop("shard").withColumnRenamed("number", "shard"), "rtree")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split(" ") for column in schema.split(", "))])


def blocks(shards: DataFrame) -> DataFrame:
    """The queries of each shard as one row; its block is the group of NEIGHBOURS shards it is searched with."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["queries"], dtype=np.int64)
                if not len(at):
                    continue
                kind, data = _bytes(_vectors(row)[at])
                made = {
                    "block": row["shard"], "ids": np.frombuffer(row["ids"], np.int64)[at].tobytes(),
                    "labels": np.frombuffer(row["labels"], np.int64)[at].tobytes(), "kind": kind, "vectors": data,
                    "width": row["width"],
                }
                yield pa.RecordBatch.from_pylist([made], schema=_arrow(_BLOCK))

    return written(shards.select(*[c.split(" ")[0] for c in _SHARD.split(", ")]).mapInArrow(taken, _BLOCK), "rtree-queries")


def _searched(pairs: DataFrame, count: int, same: bool, share: tuple[int, int] | None) -> DataFrame:
    """(query, top, id, score): what each block of ``pairs`` finds in its shard.

    ``known`` of a block are (query, top, floor): the windows of its queries and the k-th
    scores found so far. A window reaches from ``share`` of its top up to the top; without
    ``share`` there is one that holds all scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != number:
                    shard = {k: row[f"s_{k}"] for k in ("ids", "labels", "kind", "vectors", "width")}
                    number, ids, labels = row["shard"], *(np.frombuffer(shard[k], np.int64) for k in ("ids", "labels"))
                    tree = Tree(ids, labels, _vectors(shard))
                yield one(row, tree)

    def one(row: dict, tree: Tree) -> pa.RecordBatch:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        vectors = _vectors(row)
        asked: dict[int, list[tuple[int, int]]] = {}
        for known in row["known"] or []:
            asked.setdefault(known["query"], []).append((known["top"], known["floor"]))
        bounds = tree.bounds(vectors.astype(np.float64))
        out: list[tuple[np.ndarray, ...]] = []
        for i, query in enumerate(ids.tolist()):
            tops = asked.get(query, [] if share else [(LIMIT, -LIMIT)])
            if not tops:
                continue
            windows = [(-(-share[0] * top // share[1]) if share else -LIMIT, top) for top, _ in tops]
            mine = [(low[i], high[i]) for low, high in bounds]
            found = tree.search(vectors[i], int(labels[i]), windows, [f for _, f in tops], count, same, mine)
            for (top, _), (scores, hits) in zip(tops, found, strict=True):
                if len(hits):
                    out.append((np.full(len(hits), query), np.full(len(hits), top), hits, scores))
        parts = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["query", "top", "id", "score"])

    return pairs.mapInArrow(run, _FOUND)


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query", "top").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _reached(queries: DataFrame, shards: DataFrame, known: DataFrame | None, share: tuple[int, int] | None) -> DataFrame:
    """(block, shard) for the shards away from a block that a query of it may need.

    The boxes of the shards are read in pages; every block, all queries of a group of shards, is
    tested against every page.
    """
    pages = shards.select("shard", "low", "high", F.floor(F.col("shard") / PAGE).alias("page"))
    pages = pages.groupBy("page").agg(F.collect_list(F.struct("shard", "low", "high")).alias("boxes"))
    last = shards.agg(F.max("shard")).first()[0] // PAGE
    asked = _with_known(queries, known).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                boxes = row["boxes"]
                low, high = (np.array([b[k] for b in boxes]) for k in ("low", "high"))
                ids = np.frombuffer(row["ids"], np.int64).tolist()
                least, most = interval(_vectors(row).astype(np.float64), low, high)
                place = {query: k for k, query in enumerate(ids)}
                needed = np.zeros(len(boxes), dtype=bool)
                limits = [(k["query"], k["top"], k["floor"]) for k in row["known"] or []]
                if not share:
                    limits += [(q, LIMIT, -LIMIT) for q in set(ids) - {q for q, _, _ in limits}]
                for query, top, floor in limits:
                    bottom = max(floor, -(-share[0] * top // share[1])) if share else floor
                    needed |= (most[place[query]] >= bottom) & (least[place[query]] <= top)
                home = row["block"] // NEIGHBOURS
                hits = [b["shard"] for b, n in zip(boxes, needed, strict=True) if n and b["shard"] // NEIGHBOURS != home]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], names=["block", "shard"]
                )

    return asked.join(pages, "page").mapInArrow(test, "block long, shard long")


def _with_known(queries: DataFrame, known: DataFrame | None) -> DataFrame:
    """``queries`` with the list of (query, top, floor) of its own queries."""
    if known is None:
        empty = F.array().cast("array<struct<query:long,top:long,floor:long>>")
        return queries.withColumn("known", empty)
    lists = known.groupBy("block").agg(F.collect_list(F.struct("query", "top", "floor")).alias("known"))
    return queries.join(lists, "block", "left")


def _nearest(
    shards: DataFrame,
    queries: DataFrame,
    members: DataFrame,
    count: int,
    same: bool,
    tops: DataFrame | None,
    share: tuple[int, int] | None,
) -> DataFrame:
    """The first ``count`` rows in every window of every query, over all shards."""
    side = shards.select("shard", *[F.col(c).alias(f"s_{c}") for c in ("ids", "labels", "kind", "vectors", "width")])
    near = queries.withColumn(
        "shard",
        F.explode(F.sequence(F.floor(F.col("block") / NEIGHBOURS) * NEIGHBOURS, F.floor(F.col("block") / NEIGHBOURS) * NEIGHBOURS + NEIGHBOURS - 1)),
    )
    windows = None
    if tops is not None:
        windows = tops.join(members, "query").select("block", "query", "top", F.lit(-LIMIT).alias("floor"))
    beside = _with_known(near, windows).join(side, "shard")
    first = written(_first(_searched(beside, count, same, share), count), "rtree-near")
    kth = first.where(F.col("rank") == count).select("query", "top", F.col("score").alias("floor"))
    if windows is None:
        limits = kth.join(members, "query").select("block", "query", "top", "floor")
    else:
        limits = windows.drop("floor").join(kth, ["query", "top"], "left").select(
            "block", "query", "top", F.coalesce("floor", F.lit(-LIMIT)).alias("floor")
        )
    limits = written(limits, "rtree-limits")
    away = _reached(queries, shards, limits, share)
    rest = _with_known(queries, limits).join(away, "block").join(side, "shard")
    return _first(first.drop("rank").unionByName(_searched(rest, count, same, share)), count)


def mine(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the rows of ``vectors``; any row may be one. An anchor's
    positives are the first other rows of its label; a positive's negatives are the first
    rows of other labels whose score is at least ``share`` of the positive's and not above it.
    Scores are inner products of floor(256 x); higher ones come first, then smaller ids.

    Rows with a null key, label or vector or a null or non-finite component take no part. A
    shorter vector counts as padded with zeros; components and scores beyond 64 bits count as
    the largest number of 64 bits. Keys are whole numbers, labels too; of rows that share a key
    the one with the smallest label, then vector, counts. A positive without negatives gives no row, and so does a negative
    positive score, whose window is empty; an empty table gives an empty result. Equal vectors
    of one label are a class: only as many of its ids as can appear are indexed (the
    smallest), and its anchors are searched once. Other columns are not read.
    """
    vector = quantised(F.col(embedding))
    rows = vectors.where(usable(F.col(embedding), F.col(label)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"), F.max("anchor").alias("anchor"))
    rows = written(rows.select("id", "row.label", "row.vector", "anchor"), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    keep = max(positives + 1, negatives)
    order = Window.partitionBy("label", "vector").orderBy("id")
    asked = rows.where("anchor").select("id", "label", "vector")
    ranked = rows.drop("anchor").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    classes = asked.select("label", "vector").distinct().withColumn("query", F.lit(True))
    marked = ranked.join(classes, ["label", "vector"], "left").select(
        "id", "label", "vector", ((F.col("_n") == 1) & F.col("query").isNotNull()).alias("query")
    )
    least = rows.join(classes, ["label", "vector"], "left_semi").groupBy("label", "vector").agg(F.min("id").alias("query"))
    anchored = written(asked.join(least, ["label", "vector"]).select("id", "query"), "anchors")
    shards = index(written(marked, "rtree-rows"), width)
    queries = blocks(shards)
    members = queries.select("block", "ids").mapInArrow(_members, "block long, query long")
    members = written(members, "rtree-members")

    best = written(_nearest(shards, queries, members, positives + 1, True, None, None), "positives")
    tops = best.where("score >= 0").select("query", F.col("score").alias("top")).distinct()
    worst = written(_nearest(shards, queries, members, negatives, False, written(tops, "windows"), share), "negatives")

    other = anchored.join(best.select("query", F.col("id").alias("positive_id"), "score", "rank"), "query")
    other = other.where(F.col("positive_id") != F.col("id"))
    order = Window.partitionBy("id").orderBy("rank")
    chosen = other.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives)
    found = worst.select("query", F.col("top").alias("score"), F.col("id").alias("negative_id"), F.col("score").alias("n"), "rank")
    return chosen.drop("rank").join(found, ["query", "score"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), F.col("n").alias("negative_score"),
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), block)), pa.array(own)], names=["block", "query"]
            )
