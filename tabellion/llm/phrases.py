"""Phrase collocations by Toivonen mining.

A sample of the documents proposes phrases with a lowered threshold. A pass over all documents
counts every phrase that is proposed or lies on the negative border: all its shorter parts are
proposed. A border phrase that turns out frequent is a failure of the sample; it joins the
proposals and a further pass counts what they border on, until nothing frequent is left
outside. Then no frequent phrase can be uncounted, because its parts are frequent too.

Texts are cut into words once and written as 32-bit codes of the words; these passes count
48-bit codes of runs of them, which tasks add up and exchange as sorted, delta-coded blocks by
ranges of codes. Proposals go to the tasks as a bitmap of fixed size. Codes or
bits that collide can only make a phrase look more frequent. A last pass over the texts counts
the words themselves of every phrase whose code is frequent, so the counts returned are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import written

LONGEST = 4
#: bits of the bitmap of proposals; more phrases only make the border wider
BITS = 26
#: share of the documents that proposes phrases
SAMPLE = 0.125
#: words that a task counts at once, bytes of the distinct ones it remembers, bytes of text it cuts at once
BUFFER, REMEMBERED, CHUNK = 1 << 19, 1 << 20, 1 << 22
#: texts that a task holds as strings at once, bytes that a remembered word takes besides its letters
ROWS, PER_WORD = 256, 8
UNKNOWN = "und"
_BUCKET = 1 << 15

#: the lowest bits of a 64-bit code that are not used, words whose codes make a range, codes that a task adds up before it hands them on
_UNUSED, RANGE, HELD = 16, 1 << 19, 1 << 21
_BLOCKS = "words int, part long, block binary"
_CODES = "code long, words int, n long"
_PHRASES = "lang string, words int, phrase string, n long"
#: A-Z are lower-cased by bytes.lower(); these end a piece, a tab separates words like a space
_END = b"\xff"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Numbers for the words of each language, and their 32-bit codes; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.names: list[bytes] = [b""]
        self.langs: list[int] = [0]
        self.codes: list[int] = [0]
        self.tables: dict[str, _Numbers] = {}
        self.languages: list[str] = []
        self.size = 0

    def of(self, lang: str) -> _Numbers:
        if lang not in self.tables:
            self.tables[lang] = _Numbers(self, len(self.languages), seed(lang))
            self.languages.append(lang)
        return self.tables[lang]


class _Numbers(dict):
    def __init__(self, words: Words, lang: int, seed: int):
        super().__init__({_END: 0})
        self.words, self.lang, self.seed = words, lang, seed

    def __missing__(self, word: bytes) -> int:
        words = self.words
        number = self[word] = len(words.names)
        words.names.append(word)
        words.langs.append(self.lang)
        words.codes.append(code(word, self.seed))
        words.size += len(word) + PER_WORD
        return number


class Codes(dict):
    """The 32-bit codes of the words of a language; the last ones are remembered."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.seed, self.size = seed(lang), 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + PER_WORD
        if self.size > REMEMBERED:
            self.clear()
            self[_END], self.size = 0, len(word) + PER_WORD
        value = self[word] = code(word, self.seed)
        return value


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def code(word: bytes, seed: int) -> int:
    """32 bits of a word, never 0."""
    return xxhash.xxh64_intdigest(word, seed) >> 32 or 1


def cut(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, _END between pieces, some megabytes of text at a time."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    at = 0
    while at < len(data):
        stop = at + CHUNK
        if stop < len(data):
            stops = [p for p in (data.find(b" ", stop), data.find(_END, stop)) if p >= 0]
            stop = min(stops, default=len(data))
        yield data[at:stop].replace(_END, b" \xff ").split()
        at = stop


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def longer(codes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n words, from those of n - 1."""
    with np.errstate(over="ignore"):
        mixed = (codes[: len(words) - n + 1] ^ np.uint64(n)) * _STEP
        mixed = (mixed ^ (mixed >> np.uint64(29))) + words[n - 1 :]
        mixed = mixed * _STEP
        return mixed ^ (mixed >> np.uint64(32))


def within(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the codes' bits are set."""
    place = codes >> np.uint64(64 - int(np.log2(len(bitmap) * 8)))
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


Counted = tuple[int, np.ndarray, np.ndarray]
Count = Callable[[np.ndarray], Iterator[Counted]]


def _runs(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For codes of words: (n, codes of the runs of n - 1 words, codes of those of n, whether a run of n lies inside a piece)."""
    clear = words != 0
    words = spread(words)
    run = words
    for n in range(2, LONGEST + 1):
        shorter, run = run, longer(run, words, n)
        clear = clear[: len(words) - n + 1] & clear[-(len(words) - n + 1) :]
        yield n, shorter, run, clear


def spread(words: np.ndarray) -> np.ndarray:
    """64-bit codes of runs of one word."""
    with np.errstate(over="ignore"):
        mixed = words.astype(np.uint64) * _STEP
        return (mixed ^ (mixed >> np.uint64(32))) * _STEP


def count_codes(known: np.ndarray | None, before: np.ndarray | None, first: bool) -> Count:
    """Counts codes of the runs whose parts are all ``known`` and were not all known ``before``; words in the ``first`` pass."""

    def count(words: np.ndarray) -> Iterator[Counted]:
        starts = len(words) - LONGEST + 1
        if first:
            own, counts = np.unique(words[:starts], return_counts=True)
            inside = own > 0
            yield 1, spread(own[inside]), counts[inside]
        if known is None:
            return
        for n, shorter, run, clear in _runs(words):
            proposed = within(known, shorter)
            counted = proposed[:starts] & proposed[1 : starts + 1] & clear[:starts]
            if before is not None:
                done = within(before, shorter)
                counted &= ~(done[:starts] & done[1 : starts + 1])
            codes, counts = np.unique(run[:starts][counted], return_counts=True)
            if len(codes):
                yield n, codes, counts

    return count


def count_phrases(chosen: np.ndarray) -> Callable[[np.ndarray, Words], Iterator[pa.RecordBatch]]:
    """For numbers of words: counts the phrases whose code is ``chosen``, and as words 0 all words of each language."""

    def count(ids: np.ndarray, vocabulary: Words) -> Iterator[pa.RecordBatch]:
        starts = len(ids) - LONGEST + 1
        langs = np.array(vocabulary.langs, dtype=np.int32)
        names = pa.array(vocabulary.names, pa.binary())
        languages = pa.array(vocabulary.languages, pa.string())

        def batch(places: np.ndarray, n: int, counts: np.ndarray) -> pa.RecordBatch:
            parts = [names.take(pa.array(ids[places + j])) for j in range(n)]
            phrase = pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0]
            lang = languages.take(pa.array(langs[ids[places]]))
            size = pa.array(np.full(len(places), n, np.int32))
            return pa.RecordBatch.from_arrays(
                [lang, size, phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "n"]
            )

        own, at, counts = np.unique(ids[:starts], return_index=True, return_counts=True)
        own, at, counts = own[own > 0], at[own > 0], counts[own > 0]
        if not len(own):
            return
        totals = np.bincount(langs[own], counts, len(vocabulary.languages)).astype(np.int64)
        shown = totals > 0
        yield pa.RecordBatch.from_arrays(
            [languages.filter(pa.array(shown)), pa.array(np.zeros(shown.sum(), np.int32)), pa.array([""] * shown.sum(), pa.string()), pa.array(totals[shown])],
            names=["lang", "words", "phrase", "n"],
        )
        codes = np.array(vocabulary.codes, dtype=np.uint32)
        frequent = within(chosen, spread(codes[own]))
        yield batch(at[frequent], 1, counts[frequent])
        for n, _, run, clear in _runs(codes[ids]):
            place = np.flatnonzero(within(chosen, run[:starts]) & clear[:starts])
            if not len(place):
                continue
            # runs are told apart by the numbers of their words
            key = ids[place]
            for j in range(1, n):
                _, key = np.unique(key, return_inverse=True)
                key = key * len(names) + ids[place + j]
            _, at, counts = np.unique(key, return_index=True, return_counts=True)
            yield batch(place[at], n, counts)

    return count


def encoded(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (text, lang, ...) as binary rows of 32-bit codes, a 0 after each piece; other columns stay."""
    kept = [c for c in docs.columns if c not in ("text", "lang")]
    schema = T.StructType([T.StructField("words", T.BinaryType()), *[docs.schema[c] for c in kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Codes] = {}
        for batch in sliced(batches):
            rows = []
            if sum(table.size for table in tables.values()) > REMEMBERED:
                tables.clear()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                table = tables.get(lang) or tables.setdefault(lang, Codes(lang))
                parts = [np.fromiter(map(table.__getitem__, words), np.uint32, len(words)) for words in cut(text)]
                rows.append(b"".join([*(p.tobytes() for p in parts), bytes(4)]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *[batch.column(c) for c in kept]], names=["words", *kept])

    return docs.mapInArrow(run, schema)


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, sorted, and the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    del order
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(counts, starts, dtype=np.int64)


def packed(low: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes of a range as differences, and their counts, in as few bytes as all of them fit."""
    steps = np.diff(low, prepend=np.uint64(0))
    wide, large = int(steps.max()) >> 32 > 0, int(counts.max()) > 255
    steps = steps.astype(np.uint64 if wide else np.uint32)
    return bytes([wide, large]) + len(low).to_bytes(8, "little") + steps.tobytes() + counts.astype(np.uint64 if large else np.uint8).tobytes()


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, large, size = block[0], block[1], int.from_bytes(block[2:10], "little")
    end = 10 + size * (8 if wide else 4)
    steps = np.frombuffer(block[10:end], np.uint64 if wide else np.uint32)
    counts = np.frombuffer(block[end:], np.uint64 if large else np.uint8)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def passed(texts: DataFrame, count: Count, least: int, ranges: int) -> DataFrame:
    """(code, words, n) of the codes that ``count`` finds ``least`` times or more in all ``words`` of encoded texts.

    ``count`` gets some codes at a time, whatever the length of a text; the last LONGEST - 1 of
    them are only there to end the runs before them. Codes are exchanged in 2 ** ``ranges``
    ranges, of which a task adds up one at a time.
    """
    width = np.uint64(64 - _UNUSED - ranges)

    def blocks(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        while held:
            n, found = held.popitem()
            codes = np.concatenate([c for c, _ in found])
            counts = np.concatenate([k for _, k in found])
            del found
            codes >>= np.uint64(_UNUSED)
            codes, counts = added(codes, counts)
            parts = codes >> width
            edges = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(codes)])) if len(codes) else [0]
            low = codes & ((np.uint64(1) << width) - np.uint64(1))
            pairs = list(zip(edges[:-1], edges[1:], strict=True))
            rows = [packed(low[i:j], counts[i:j]) for i, j in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(rows), pa.int32()), pa.array([int(parts[i]) for i, _ in pairs], pa.int64()), pa.array(rows, pa.binary())],
                names=["words", "part", "block"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def take(words: np.ndarray) -> None:
            for n, codes, counts in count(words):
                held.setdefault(n, []).append((codes, counts.astype(np.int32)))

        for batch in batches:
            for row in batch.column(0):
                words = np.frombuffer(row.as_buffer(), dtype=np.uint32)
                for at in range(0, len(words), BUFFER):
                    waiting.append(words[at : at + BUFFER])
                    size += len(waiting[-1])
                    if size < BUFFER:
                        continue
                    now = np.concatenate(waiting)
                    take(now)
                    waiting, size = [now[len(now) - LONGEST + 1 :]], LONGEST - 1
                    if sum(len(c) for found in held.values() for c, _ in found) >= HELD:
                        yield from blocks(held)
        if waiting:
            take(np.concatenate([*waiting, np.zeros(LONGEST - 1, np.uint32)]))
        yield from blocks(held)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, part = (k.as_py() for k in key)
        parts = [unpacked(block) for block in table.column("block").to_pylist()]
        low, counts = added(np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts]))
        low, counts = low[counts >= least], counts[counts >= least]
        codes = ((np.uint64(part) << width) | low) << np.uint64(_UNUSED)
        words = pa.array(np.full(len(codes), n, np.int32))
        return pa.table([pa.array(codes.view(np.int64)), words, pa.array(counts)], names=["code", "words", "n"])

    return texts.select("words").mapInArrow(run, _BLOCKS).groupBy("words", "part").applyInArrow(add, _CODES)


def named(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(lang, words, phrase, n) of the phrases of ``docs`` (text, lang) whose code is ``chosen``, still to be added up."""
    count = count_phrases(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = Words(), [], 0
        closing = np.zeros(LONGEST - 1, dtype=np.int64)
        for batch in sliced(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                numbers = vocabulary.of(lang)
                for words in cut(text):
                    held.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    size += len(words)
                    if size < BUFFER:
                        continue
                    ids = np.concatenate(held)
                    yield from count(ids, vocabulary)
                    rest = ids[len(ids) - LONGEST + 1 :]
                    if vocabulary.size > REMEMBERED:
                        names = [vocabulary.names[i] if i else _END for i in rest]
                        old = [vocabulary.languages[vocabulary.langs[i]] for i in rest]
                        # words and their tables refer to each other
                        vocabulary.tables.clear()
                        vocabulary = Words()
                        rest = np.array([vocabulary.of(o)[w] for o, w in zip(old, names, strict=True)], dtype=np.int64)
                        numbers = vocabulary.of(lang)
                    held, size = [rest], len(rest)
                held.append(closing[:1])
                size += 1
        if held:
            yield from count(np.concatenate([*held, closing]), vocabulary)

    return docs.select("text", "lang").mapInArrow(run, _PHRASES)


def bitmap(codes: DataFrame, bits: int) -> np.ndarray:
    """The highest bits of the codes; at most 2 ** (bits - 15) rows of 4 KB come to the driver."""
    place = F.shiftrightunsigned("code", 64 - bits)
    rows = codes.select(F.floor(place / _BUCKET).alias("bucket"), (place % _BUCKET).alias("bit"))
    made = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for bucket, part in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("part")).collect():
        made[bucket * (_BUCKET // 8) : (bucket + 1) * (_BUCKET // 8)] |= np.frombuffer(part, dtype=np.uint8)
    return made


def closed(texts: DataFrame, least: int, known: np.ndarray | None = None, bits: int = BITS) -> tuple[DataFrame, np.ndarray, int]:
    """For encoded texts: (code, words) of all phrases with at least ``least`` occurrences, the bitmap of those that others contain, number of passes.

    Passes go on until every frequent phrase is known, at most LONGEST + 1 of them: the first
    counts all words, each further one completes phrases that are one word longer.
    """
    total = texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    ranges = min(20, max(4, (total // 4 // RANGE).bit_length()))
    before, found, passes = None, None, 0
    while True:
        new = passed(texts, count_codes(known, before, first=not passes), least, ranges)
        new = written(new.select("code", "words"), "phrase-codes")
        found = new if found is None else found.unionByName(new)
        passes += 1
        grown = bitmap(new.where(F.col("words") < LONGEST), bits)
        if known is not None:
            grown |= known
            if (grown == known).all():
                return found, known, passes
        before, known = known, grown


def frequent(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    least: int = 30,
    sample: float = SAMPLE,
    bits: int = BITS,
) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of up to LONGEST words with ``least`` or more occurrences, by Toivonen mining.

    A row with words 0 has the number of all words of a language. The sample (a share of the
    documents, by the hash of key and text) and its lowered threshold decide how many passes
    there are, not what they find.
    """
    hashed = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    rows = docs.select(
        F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), hashed.alias("hash")
    )
    sampled = (F.pmod("hash", F.lit(1 << 20)) < int(sample * (1 << 20))).alias("sampled")
    texts = written(encoded(rows.where("text <> ''").select("text", "lang", sampled)), "phrase-words")
    known = None
    if sample > 0:
        chosen = written(texts.where("sampled"), "phrase-sample")
        expected = least * sample
        known = closed(chosen, max(2, round(expected - sqrt(expected))), bits=bits)[1]
    codes, _, _ = closed(texts, least, known, bits)
    counted = named(rows, bitmap(codes, bits))
    counted = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | (F.col("words") == 0))


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    least: int = 30,
    first: int = 2000,
    scale: int = 2_000_000,
    contained: tuple[int, int] = (80, 100),
    sample: float = SAMPLE,
    bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` collocations of every language.

    Candidates are phrases of 2 to LONGEST words with a >= ``least`` occurrences inside pieces
    of text; cut after k words into parts with l and r occurrences they score floor(scale * a /
    (l + r)), at the cut where that is least (then the smallest k). A candidate inside a longer
    one that has at least ``contained`` of its occurrences is dropped. Order: score and a
    descending, phrase. n counts all words of the language.

    A null text is empty, a null language ``und``; repeated rows count again; empty texts and
    tables give nothing; only the three named columns are read. All counts are exact, also
    where products pass 64 bits.
    """
    found = written(frequent(docs, text, lang, doc_id, least, sample, bits), "frequent-phrases")
    counted = found.where("words > 0").select("lang", "words", "phrase", "n")
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = counted.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    size = F.col("words")
    lengths = F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    inside = candidates.where("words > 2").select("lang", "w", "a", size, lengths)
    inside = inside.select("lang", "w", "a", "length", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("start"))
    inside = inside.groupBy("lang", _joined(F.col("w"), F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("_longer"))
    part, whole = (F.lit(c).cast("decimal(20,0)") for c in contained)
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (whole * F.col("_longer").cast("decimal(17,0)") < part * F.col("a").cast("decimal(17,0)"))
    )

    cuts = kept.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({
        "_left": _joined(F.col("w"), F.lit(1), F.col("k")), "_right": _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k"))
    })
    left = counted.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    ranked = lowest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
