"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one bit per position: 1 if the bit is set in more than half of the hashes
of the text's word shingles. Fingerprints that differ in few bits are linked: each is cut
into segments, a small Hamming ball around every segment value is looked up in that
segment's table, and the whole distance of what matches is verified. If two codes differ
in at most k bits, one of m segments differs in at most k // m bits, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import components, written

SEED = 42
#: shingles whose bits are counted at once, so that a long text needs bounded memory
BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of ``text`` as a signed number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    values = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values)).view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``name`` (long): the SimHash over shingles of ``size`` words.

    A-Z are lower-cased, words are runs of other characters than ASCII white space, repeated
    shingles count again, a text with fewer words is one shingle, one without words (or
    null) has fingerprint 0.
    """

    @F.pandas_udf(T.LongType())
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn(name, hashed(F.col(text)))


def ball(width: int, radius: int) -> list[int]:
    """Every mask of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def segment_widths(bits: int, segments: int) -> list[int]:
    return [bits // segments + (i < bits % segments) for i in range(segments)]


def segment_values(code: Column, widths: list[int]) -> list[Column]:
    parts, low = [], 0
    for width in widths:
        parts.append(F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else code)
        low += width
    return parts


def hamming_pairs(codes: DataFrame, radius: int, segments: int, bits: int, within: int | None = None) -> DataFrame:
    """Pairs of different codes that agree up to ``radius`` bits in one of the segments.

    ``codes`` has the columns code (long), unique, and any others; the result has each of
    them as left_<name> and right_<name>, one row per pair. ``within`` keeps the pairs whose
    whole distance is at most that. Of two values that differ by a mask, only the one with
    the mask's highest bit looks the other up; a pair that agrees in several segments is
    kept in the first of them, so no pair appears twice and none needs to be removed.
    """
    widths, tables, probes = segment_widths(bits, segments), [], []
    for i, (width, value) in enumerate(zip(widths, segment_values(F.col("code"), widths), strict=True)):
        masks = F.array(*[F.lit(signed(m)).cast("long") for m in ball(width, radius)])
        tops = F.array(*[F.lit(signed(1 << m.bit_length() >> 1)).cast("long") for m in ball(width, radius)])
        tables.append(F.struct(F.lit(i).alias("segment"), value.alias("key")))
        rows = codes.select(
            *[F.col(c).alias(f"left_{c}") for c in codes.columns],
            F.lit(i).alias("segment"),
            value.alias("_value"),
            F.explode(F.arrays_zip(masks.alias("mask"), tops.alias("top"))).alias("_ball"),
        )
        rows = rows.where(F.col("_value").bitwiseAND(F.col("_ball.top")) == F.col("_ball.top"))
        probes.append(
            rows.withColumn("key", F.col("_value").bitwiseXOR(F.col("_ball.mask")))
            .withColumn("_same", F.col("_ball.mask") == 0)
            .drop("_value", "_ball")
        )
    index = codes.select(
        *[F.col(c).alias(f"right_{c}") for c in codes.columns], F.explode(F.array(*tables)).alias("_t")
    ).select("*", "_t.segment", "_t.key")
    probe = probes[0]
    for more in probes[1:]:
        probe = probe.unionByName(more)
    pairs = probe.join(index.drop("_t"), ["segment", "key"]).where(
        ~F.col("_same") | (F.col("left_code") < F.col("right_code"))
    )
    apart = F.col("left_code").bitwiseXOR(F.col("right_code"))
    if within is not None:
        pairs = pairs.where(F.bit_count(apart) <= within)
    first = F.lit(True)
    for i, part in enumerate(segment_values(apart, widths)):
        first = first & ((F.col("segment") <= i) | (F.bit_count(part) > radius))
    return pairs.where(first).drop("segment", "key", "_same")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 3,
    max_distance: int = 3,
    segments: int = 2,
) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (long) and ``component_id``.

    Fingerprints at ``max_distance`` or fewer bits are linked; the component is the smallest
    ``doc_id`` that links reach. Equal fingerprints are one node, so a group of copies costs
    one row in the search however large it is. Only the key and the fingerprint are kept
    besides (input columns of those two names are replaced); texts are not shuffled. Rows
    with a null key get a fingerprint and the component of it, null if no row there has a
    key. Empty input gives an empty result.
    """
    rows = written(
        fingerprints(docs.select(F.col(doc_id), F.col(text).alias("_text")), "_text", size).drop("_text"), "simhash"
    )
    return rows.join(classes(rows, doc_id, max_distance, segments), "fingerprint").select(
        doc_id, "fingerprint", "component_id"
    )


def classes(rows: DataFrame, doc_id: str, max_distance: int = 3, segments: int = 2) -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint of ``rows``."""
    nodes = written(rows.groupBy("fingerprint").agg(F.min(doc_id).alias("_least")), "simhash-nodes")
    pairs = hamming_pairs(
        nodes.select(F.col("fingerprint").alias("code")), max_distance // segments, segments, 64, max_distance
    )
    parts = components(pairs, "left_code", "right_code")
    placed = nodes.join(parts, nodes.fingerprint == parts.node, "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_class")
    )
    least = placed.groupBy("_class").agg(F.min("_least").alias("component_id"))
    return placed.join(least, "_class").select("fingerprint", "component_id")


def hex_digits(code: Column) -> Column:
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
