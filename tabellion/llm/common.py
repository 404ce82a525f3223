"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabellion.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``text`` and ``label`` of at most ``rows`` labelled documents, chosen by the hash of the key.

    ``learn`` is a condition on ``doc_id`` of ``labels``. Repeated labels of a document are
    averaged (half counts as 1); null labels, null keys and null texts teach nothing. Of rows that share
    a key the text with the smallest digest is taken, so that ``rows`` bounds what is returned.
    """
    chosen = (
        labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    # at most ``rows`` rows of two numbers: the size is bounded by the parameter
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))
    return found.select("text", "label")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps. Every step is a map-side combined minimum
    per node and an equi-join, so a node with many neighbours is never gathered in one task.
    The edges of each round are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where(a != b)
    now = written(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(b.alias("a")).distinct().select("a", a.alias("b"))
    return now.unionByName(roots).select(a.alias("node"), b.alias("component"))


def code_points(text: str) -> np.ndarray:
    """The code points of ``text`` as unsigned integers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` hashed to ``bits`` bits (multiply and shift)."""
    values = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * _MIX
    return (values >> np.uint64(64 - bits)).astype(np.uint32)


def grams(codes: np.ndarray, sizes: Iterable[int]) -> Iterable[np.ndarray]:
    """A 64-bit value for each run of n codes, one array for each n."""
    wide = codes.astype(np.uint64)
    for n in sizes:
        if len(wide) < n:
            continue
        total = np.full(len(wide) - n + 1, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total * np.uint64(1000003) + wide[i : len(wide) - n + 1 + i]
        yield total


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(values, -50, 50)))


def logistic(features: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a logistic curve through rows of features, by damped Newton steps."""
    x = np.column_stack([features, np.ones(len(labels))])
    at = np.zeros(x.shape[1])
    smooth = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(rounds):
        p = sigmoid(x @ at)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(at))
        step = np.linalg.solve(hessian, x.T @ (p - smooth) + 1e-3 * at)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return at[:-1], float(at[-1])


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray | float]],
    signs: np.ndarray,
    size: int,
    cost: np.ndarray,
    rounds: int = 15,
    seed: int = 7,
) -> np.ndarray:
    """Weights of a linear hinge-loss classifier by dual coordinate descent.

    ``rows`` are (indices, values) pairs of sparse vectors, ``signs`` -1 or 1, ``cost`` the
    upper bound of each row's multiplier.
    """
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(np.sum(np.square(v)) if np.ndim(v) else v * v * len(i)) for i, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for k in order.permutation(len(rows)):
            if norms[k] == 0:
                continue
            index, value = rows[k]
            gradient = signs[k] * float(np.sum(weights[index] * value)) - 1.0
            new = min(max(alpha[k] - gradient / norms[k], 0.0), cost[k])
            change = new - alpha[k]
            if change:
                weights[index] += change * signs[k] * value
                alpha[k] = new
                largest = max(largest, abs(change) * norms[k])
        if largest < 1e-3:
            break
    return weights
