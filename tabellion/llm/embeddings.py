"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated vectors lose
little (iterative quantisation); the signs are a binary code. Codes that agree up to a few
bits in one of their segments are retrieved from that segment's table, and the pairs are
reranked by the cosine of the original vectors in double precision. Segments widen with the
number of vectors, so that each catches fewer of the links; codes of further, random rotations
are added until the tables together miss no more than a fixed share at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, comb, log, log2, sqrt
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import components, written
from tabellion.llm.simhash import hamming_pairs, segment_values, segment_widths

#: vectors that the rotation is learned from, at most (the index itself holds all)
SAMPLE_ROWS = 20_000
BITS = 64
COSINE = 0.95
#: Hamming radius searched in each segment, and whole distance up to which pairs are reranked at least
RADIUS, WITHIN = 2, 20
#: share of the pairs at the threshold that no table may find, whatever the number of vectors
MISSED = 0.0025


@dataclass
class Rotation:
    """The mean of the unit vectors and the projection to code bits."""

    mean: np.ndarray
    projection: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Signed 64-bit codes of rows of unit vectors; bits beyond the projection are 0."""
        bits = np.zeros((len(unit), 64), dtype=np.uint64)
        bits[:, : self.projection.shape[1]] = (unit - self.mean) @ self.projection > 0
        return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def learn_rotation(unit: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 3) -> Rotation:
    """Principal axes, then turns of quantising and the best rotation towards the signs."""
    mean = unit.mean(axis=0) if len(unit) else np.zeros(unit.shape[1])
    centred = unit - mean
    bits = min(bits, unit.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    values = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(values @ turn > 0, 1.0, -1.0).T @ values)
        turn = (left @ right).T
    return Rotation(mean, axes @ turn)


def flip_rate(unit: np.ndarray, rotations: list[Rotation], cosine: float, seed: int = 4) -> float:
    """Share of code bits in which vectors at ``cosine`` differ, at least that of random planes.

    Each vector is turned by the angle towards another one, and in a random direction.
    """
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    rates = [angle / np.pi]
    noise = np.random.default_rng(seed).standard_normal(unit.shape)
    for other in (np.roll(unit, 1, axis=0), noise):
        across = other - np.einsum("ij,ij->i", unit, other)[:, None] * unit
        length = np.sqrt(np.square(across).sum(axis=1))
        usable = length > 1e-6
        if not usable.any():
            continue
        turned = np.cos(angle) * unit[usable] + np.sin(angle) * across[usable] / length[usable, None]
        for rotation in rotations:
            apart = (rotation.codes(unit[usable]) ^ rotation.codes(turned)).view(np.uint64)
            rates.append(float(np.bitwise_count(apart).mean()) / rotation.projection.shape[1])
    return min(0.5, max(rates))


def tables(count: int, bits: int, flip: float, radius: int = RADIUS) -> tuple[int, int, int]:
    """(segments, width, rotations) of an index of ``count`` codes.

    Segments are as wide as the logarithm of the number of codes, so that a table entry holds
    a few codes at every size; there are as many rotations as keep the share of pairs that
    share no probed segment below MISSED, if bits flip at the rate ``flip``.
    """
    wide = max(8.0, log2(max(2, count)))
    segments = max(1, min(bits, round(bits / wide)))
    width = min(bits // segments, ceil(wide))
    caught = sum(comb(width, k) * flip**k * (1 - flip) ** (width - k) for k in range(min(radius, width) + 1))
    needed = ceil(log(MISSED) / log(1 - caught)) if caught < 1 - MISSED else 1
    return segments, width, ceil(needed / segments)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(least, size, vector, width): one row per distinct usable vector, the smallest key and number of its copies.

    Usable is a vector that is not null or empty, has no null or non-finite component and is
    not zero; vectors are padded with zeros to the widest, their own width stays with them.
    """
    values = F.col(embedding).cast("array<double>")
    finite = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("_id"), values.alias("vector")).where(finite)
    return rows.groupBy("vector").agg(F.min("_id").alias("least"), F.count("*").alias("size")).select(
        "least", "size", F.size("vector").alias("width"), "vector"
    )


@dataclass
class Plan:
    """The rotations of an index and how their codes are cut into tables."""

    rotations: list[Rotation]
    widest: int
    bits: int
    segments: int
    width: int
    within: int


def plan(
    nodes: DataFrame,
    cosine: float = COSINE,
    radius: int = RADIUS,
    within: int = WITHIN,
    sample_rows: int = SAMPLE_ROWS,
    count: int | None = None,
) -> Plan | None:
    """The index for ``nodes`` (vector, width, ...), laid out for ``count`` vectors (by default theirs); None for no nodes.

    The first rotation is learned from at most ``sample_rows`` vectors, chosen by their hash;
    further ones turn the same axes at random.
    """
    size, widest = nodes.agg(F.count("*"), F.max("width")).first()
    if widest is None:
        return None
    sample = _padded(nodes, widest).orderBy(F.xxhash64("vector"), "least").limit(sample_rows).select("vector").toArrow()
    unit = _unit(_matrix(sample.column("vector").combine_chunks(), widest))
    bits = min(BITS, widest)
    rotations = [learn_rotation(unit, bits), learn_rotation(unit, bits, 0, 11)]
    flip = flip_rate(unit, rotations, cosine)
    segments, width, number = tables(size if count is None else count, bits, flip, radius)
    rotations += [learn_rotation(unit, bits, 0, 10 + i) for i in range(2, number)]
    spread = ceil(bits * flip + 5.5 * sqrt(bits * flip * (1 - flip)))
    return Plan(rotations[:number], widest, bits, segments, width, max(within, spread))


def _padded(nodes: DataFrame, widest: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), F.lit(widest) - F.col("width"))
    return nodes.withColumn("vector", F.concat("vector", zeros))


def index(nodes: DataFrame, made: Plan) -> DataFrame:
    """``nodes`` with ``codes``, one per rotation; vectors are padded to the widest and scaled to length 1 for the code."""
    rotations, widest = made.rotations, made.widest

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            unit = _unit(np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), widest))
            yield pd.Series(list(np.stack([r.codes(unit) for r in rotations], axis=1)), dtype=object)

    return _padded(nodes, widest).withColumn("codes", coded("vector"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True, initial=1e-300)
    return scaled / np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))


def links(
    nodes: DataFrame, cosine: float = COSINE, radius: int = RADIUS, within: int = WITHIN, count: int | None = None
) -> DataFrame:
    """(left, right, left_size, right_size) for pairs of distinct vectors of one width with at least that cosine.

    Vectors of one code are one entry of the tables; their pairs are formed after the search.
    A pair that several rotations bring up is kept in the first of them. ``count`` lays the
    tables out for another number of vectors.
    """
    made = plan(nodes, cosine, radius, within, count=count)
    if made is None:
        return nodes.sparkSession.createDataFrame([], "left long, right long, left_size long, right_size long")
    coded = written(index(nodes, made), "codes")
    bits = made.segments * made.width
    radius = min(radius, made.width)

    def side(name: str) -> DataFrame:
        return coded.select(*[
            F.col(c).alias(f"{name}_{c}") for c in ("codes", "least", "size", "width", "vector")
        ])

    def probed(number: int) -> Column:
        """Whether the codes of one rotation bring a pair up."""
        apart = F.col("left_codes")[number].bitwiseXOR(F.col("right_codes")[number])
        parts = segment_values(apart, segment_widths(bits, made.segments))
        close = reduce(or_, [F.bit_count(part) <= radius for part in parts])
        return close & (F.bit_count(apart) <= made.within)

    found = []
    for number in range(len(made.rotations)):
        codes = written(coded.select(F.col("codes")[number].alias("code")).distinct(), "distinct-codes")
        near = hamming_pairs(codes, radius, made.segments, bits, made.within)
        near = near.unionByName(codes.select(F.col("code").alias("left_code"), F.col("code").alias("right_code")))
        left = side("left").withColumn("left_code", F.col("left_codes")[number])
        right = side("right").withColumn("right_code", F.col("right_codes")[number])
        pairs = near.join(left, "left_code").join(right, "right_code").where(
            (F.col("left_width") == F.col("right_width"))
            & ((F.col("left_code") != F.col("right_code")) | (F.col("left_least") < F.col("right_least")))
        )
        for earlier in range(number):
            pairs = pairs.where(~probed(earlier))
        found.append(pairs)
    schema = "left long, right long, left_size long, right_size long"

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("left_vector")[0])
            a, b = (_unit(_matrix(batch.column(f"{n}_vector"), width)) for n in ("left", "right"))
            keep = pa.array(np.einsum("ij,ij->i", a, b) >= cosine)
            columns = [batch.column(n) for n in ("left_least", "right_least", "left_size", "right_size")]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["left", "right", "left_size", "right_size"])

    columns = ["left_least", "right_least", "left_size", "right_size", "left_vector", "right_vector"]
    return reduce(DataFrame.unionByName, [pairs.select(*columns) for pairs in found]).mapInArrow(rerank, schema)


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    n_links counts the other vectors at ``cosine`` or more, exact copies among them without
    being compared; component_id is the smallest key that links reach; kept is whether that
    is the vector's own. Vectors that are null, empty, zero or hold null or non-finite
    components have no links and are a component each; a null key has component null.
    Keys are whole numbers and unique.
    """
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).alias("_vector"))
    nodes = written(classes(rows, "_id", "_vector"), "vectors")
    found = written(links(nodes.where("least is not null"), cosine), "links")
    both = found.select("left", F.col("right_size").alias("n")).unionByName(
        found.select(F.col("right").alias("left"), F.col("left_size").alias("n"))
    )
    degree = both.groupBy(F.col("left").alias("least")).agg(F.sum("n").alias("_linked"))
    parts = components(found, "left", "right").select(F.col("node").alias("least"), "component")
    placed = nodes.join(degree, "least", "left").join(parts, "least", "left").select(
        F.col("vector").alias("_class"),
        (F.coalesce("_linked", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "least").alias("component_id"),
    )
    joined = rows.withColumn("_class", F.col("_vector").cast("array<double>")).join(placed, "_class", "left")
    component = F.coalesce("component_id", "_id")
    return joined.select(
        F.col("_id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )
