"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of lower-cased words. Runs of a few words (seeds) that a
text shares with an item are joined; for each such pair the tiling repeatedly marks the
longest matches between unmarked words, found by running Karp-Rabin hashes, until none of
the least length is left. The share of the item's words that tiles cover does not depend on
their order, so reordered passages are found like straight ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: least words of a tile, and share of an item's words that must be covered
LEAST, COVERAGE = 5, 0.8
#: items per block of the index that tasks hold; further blocks read the texts again
BLOCK_ITEMS = 20_000
_WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003
_MASK = (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Index:
    """The items of a block: word numbers, each item's words, and the items of each seed."""

    numbers: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray, int]] = field(default_factory=list)
    seeds: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    sorted_seeds: dict[int, np.ndarray] = field(default_factory=dict)
    least: int = LEAST

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], least: int = LEAST) -> Index:
        """An item shorter than ``least`` words is matched by all of its words; one without words never."""
        out = cls(least=least)
        by_size: dict[int, set[int]] = defaultdict(set)
        for item, text in rows:
            found = [out.numbers.setdefault(w, len(out.numbers) + 1) for w in words(text)]
            if not found:
                continue
            size = min(least, len(found))
            codes = np.array(found, dtype=np.int64)
            out.items.append((item, codes, size))
            for seed in np.unique(runs(codes, size)).tolist():
                out.seeds[seed].append(len(out.items) - 1)
                by_size[size].add(seed)
        out.seeds = dict(out.seeds)
        out.sorted_seeds = {n: np.array(sorted(v), dtype=np.int64) for n, v in by_size.items()}
        return out

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, coverage, longest tile, tiles) for every item that shares a seed with the text."""
        codes = np.array([self.numbers.get(w, 0) for w in words(text)], dtype=np.int64)
        places: dict[int, list[int]] = defaultdict(list)
        for size, known in self.sorted_seeds.items():
            if len(codes) < size:
                continue
            found = runs(codes, size)
            whole = np.flatnonzero(found >= 0)
            at = np.minimum(np.searchsorted(known, found[whole]), len(known) - 1)
            for place in whole[known[at] == found[whole]].tolist():
                for number in self.seeds[int(found[place])]:
                    if self.items[number][2] == size:
                        places[number].append(place)
        out = []
        for number in sorted(places):
            item, pattern, size = self.items[number]
            tiles = tile(pattern, stretches(codes, places[number], size), size)
            if tiles:
                out.append((item, sum(tiles) / len(pattern), max(tiles), len(tiles)))
        return out


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A rolling (Karp-Rabin) value for each run of ``size`` words; -1 if it holds an unknown word (0)."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    total, unknown = np.full(count, size, dtype=np.uint64), np.zeros(count, dtype=bool)
    with np.errstate(over="ignore"):
        for i in range(size):
            part = codes[i : i + count]
            total = total * np.uint64(_BASE) + part.astype(np.uint64)
            unknown |= part == 0
    total = (total >> np.uint64(2)).astype(np.int64)
    total[unknown] = -1
    return total


def stretches(codes: np.ndarray, places: list[int], size: int) -> list[int]:
    """The words of the text that lie in a shared seed, a 0 between stretches.

    No tile can reach a word outside, so tiling the stretches tiles the text.
    """
    out: list[int] = []
    end = -1
    for place in sorted(places):
        if place > end and out:
            out.append(0)
        out.extend(codes[max(place, end) : place + size].tolist())
        end = place + size
    return out


def tile(pattern: np.ndarray, text: list[int], least: int) -> list[int]:
    """Lengths of the tiles of greedy string tiling; no word of either side is in two tiles.

    Of the matches found at a search length the longest are marked, those that start first
    in the pattern, then in the text, before others; then the rest is searched again. The
    search length is halved when nothing is found, down to ``least``.
    """
    pattern_words = pattern.tolist()
    marked = [False] * len(pattern_words)
    taken = [word == 0 for word in text]
    tiles: list[int] = []
    length = max(least, min(len(pattern_words), len(text)))
    while True:
        found = _scan(pattern_words, marked, text, taken, length)
        if not found:
            if length <= least:
                return tiles
            length = max(least, length // 2)
            continue
        longest = max(found)[0]
        for n, i, j in sorted(m for m in found if m[0] == longest):
            if not any(marked[i : i + n]) and not any(taken[j : j + n]):
                marked[i : i + n] = [True] * n
                taken[j : j + n] = [True] * n
                tiles.append(n)


def _scan(
    pattern: list[int], marked: list[bool], text: list[int], taken: list[bool], length: int
) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words: (words, start in pattern, start in text)."""
    table: dict[int, list[int]] = defaultdict(list)
    for j, value in _hashes(text, taken, length):
        table[value].append(j)
    out = []
    for i, value in _hashes(pattern, marked, length):
        for j in table.get(value, ()):
            n = 0
            while (
                i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n]
                and not marked[i + n] and not taken[j + n]
            ):
                n += 1
            if n >= length:
                out.append((n, i, j))
    return out


def _hashes(codes: list[int], closed: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Start and running hash of every run of ``length`` words that are not marked."""
    top = pow(_BASE, length - 1, _MASK)
    value, size = 0, 0
    for end, code in enumerate(codes):
        if closed[end]:
            value, size = 0, 0
            continue
        if size == length:
            value = (value - codes[end - length] * top) % _MASK
            size -= 1
        value = (value * _BASE + code) % _MASK
        size += 1
        if size == length:
            yield end - length + 1, value


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per (document row, item) whose tiles cover at least ``coverage`` of the item's words.

    Columns: the key of the document, item_id, coverage, longest_tile, tiles. The items are
    a stated query set: they are read in blocks of BLOCK_ITEMS, each held as an index by
    the tasks, and every block is matched against all texts. Null or empty texts and items
    match nothing; repeated rows match each on its own; empty tables give an empty result.
    """
    spark = docs.sparkSession
    key = docs.schema[doc_id].dataType.simpleString()
    item_key = benchmark.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {key}, item_id {item_key}, coverage double, longest_tile int, tiles int"
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))):
        index = Index.build(block, least)  # travels with the function; bounded by BLOCK_ITEMS

        def tiled(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (doc, *match)
                    for doc, value in zip(batch["_id"].tolist(), batch["_text"], strict=True)
                    for match in index.matches(value)
                    if match[1] >= coverage
                ]
                yield pd.DataFrame(rows, columns=["_id", "item_id", "coverage", "longest_tile", "tiles"]).rename(
                    columns={"_id": doc_id}
                )

        out = out.unionByName(texts.mapInPandas(tiled, schema))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Lists of at most BLOCK_ITEMS (item, text), streamed to the driver one by one."""
    block: list[tuple[int, str | None]] = []
    for row in items.where(F.col("text").isNotNull()).toLocalIterator():
        block.append((row["item"], row["text"]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits
) -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item matches.

    Rows are told by the digest of their text, so keys may be null or repeat.
    """
    digest = F.md5(text).alias("_digest")
    found = matches(docs.select(digest, text), benchmark, "_digest", text, **limits).select(F.col("_digest").alias("_found"))
    return docs.join(found.distinct(), F.md5(text) == F.col("_found"), "left_anti")
