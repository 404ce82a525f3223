"""Which of many patterns each of many texts contains, for the texts of one task, in arrays.

White space is that of ``\\s`` in a regular expression, so a pattern without it lies inside a word.
Texts and patterns are compared as UTF-8.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: odd, spreads keys over a table
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: bytes of words, and pairs of text and pattern, that are worked on at once
_SLICE, _PAIRS = 1 << 19, 1 << 20
#: a pattern that may be in more than one of so many texts is collected by marks
_SPARSE = 64

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start``, ``start + 1``, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _table(known: np.ndarray) -> np.ndarray:
    """Marks that a key of ``known`` may be at, at least sixteen for each."""
    bits = (16 * len(known)).bit_length()
    table = np.zeros(1 << bits, dtype=bool)
    table[(known * _ODD) >> np.uint64(64 - bits)] = True
    return table


def _looked_up(keys: np.ndarray, known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, place): the keys that are among the sorted ``known``; most others are passed over by the table."""
    at = np.flatnonzero(table[(keys * _ODD) >> np.uint64(65 - len(table).bit_length())])
    place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
    same = known[place] == keys[at]
    return at[same], place[same]


def _packed(words: Sequence[bytes], tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """The last or the first eight bytes of each word as a number, and which of its bytes there are."""
    letters = np.array([int.from_bytes(w[:-9:-1] if tail else w[:8], "little") for w in words], dtype=np.uint64)
    return letters, np.array([(1 << 8 * min(len(w), 8)) - 1 for w in words], dtype=np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros beyond the end."""
    eights = np.zeros(len(data), dtype=np.uint64)
    for i in range(min(8, len(data))):
        eights[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    return eights


def _key(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """What tells runs of ``length`` bytes: all of them up to eight, else something of the first and the last eight."""
    if length <= 8:
        return eights[at] & np.uint64((1 << 8 * length) - 1)
    return eights[at] * _ODD ^ eights[at + (length - 8)]


def _within(data: np.ndarray, offsets: np.ndarray, cores: Sequence[bytes]) -> np.ndarray:
    """core << 32 | word, sorted: the cores that lie in each word, once each; words are the bytes between offsets."""
    by_length = defaultdict(list)
    for k, core in enumerate(cores):
        by_length[len(core)].append(k)
    core_eights = _eights(np.frombuffer(b"".join(cores), dtype=np.uint8))
    core_at = np.append(0, np.cumsum(np.fromiter(map(len, cores), np.int64, len(cores))))
    wanted = []
    for length in sorted(by_length):
        own = np.array(by_length[length])
        keys = _key(core_eights, core_at[own], length)
        order = np.argsort(keys, kind="stable")
        known, first = np.unique(keys[order], return_index=True)
        wanted.append((length, own[order], known, np.append(first, len(own)), _table(known)))
    found: list[np.ndarray] = []
    low, words, slices = 0, len(offsets) - 1, 0
    while low < words:
        high = max(int(np.searchsorted(offsets, offsets[low] + _SLICE, side="right")) - 1, low + 1)
        base = offsets[low]
        eights = _eights(data[base : offsets[high]])
        lengths = np.diff(offsets[low : high + 1])
        word_at = np.repeat(np.arange(low, high, dtype=np.int32), lengths)
        at = np.arange(len(eights))
        left = np.repeat(offsets[low + 1 : high + 1] - base, lengths) - at
        for length, own, known, first, table in wanted:
            fits = left >= length
            at, left = at[fits], left[fits]
            if not len(at):
                break
            which, place = _looked_up(_key(eights, at, length), known, table)
            start = at[which]
            if length <= 8:
                found.append(own[place] << 32 | word_at[start])
                continue
            counts = first[place + 1] - first[place]
            start, core = np.repeat(start, counts), own[stretches(first[place], counts)]
            for shift in {*range(0, length - 8, 8), length - 8}:
                same = eights[start + shift] == core_eights[core_at[core] + shift]
                start, core = start[same], core[same]
            found.append(core << 32 | word_at[start])
        if found:
            found[slices:] = [_distinct(np.concatenate(found[slices:]))] if len(found) > slices else []
            slices = len(found)
        low = high
    return _distinct(concatenated(found, np.int64))


class Texts:
    """Texts cut into words, to be asked for any number of patterns."""

    def __init__(self, texts: pa.ChunkedArray):
        self.texts = texts.chunks
        self.n = len(texts)
        flat, docs, base = [], [], 0
        for chunk in self.texts:
            split = pc.ascii_split_whitespace(chunk)
            flat.append(split.flatten())
            docs.append(np.repeat(np.arange(base, base + len(chunk), dtype=np.int32), np.diff(split.offsets.to_numpy())))
            base += len(chunk)
        encoded = pa.chunked_array(flat, pa.string()).dictionary_encode()
        del flat
        vocabulary = encoded.chunk(0).dictionary if encoded.num_chunks else pa.array([], pa.string())
        self.vocabulary = vocabulary
        codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in encoded.chunks)])
        docs = np.concatenate([np.zeros(0, np.int32), *docs])
        empty = vocabulary.index("").as_py()
        if empty >= 0:
            docs, codes = docs[codes != empty], codes[codes != empty]
        self.codes, self.docs, self.eights = codes, docs, {}
        if len(vocabulary):
            _, offsets, data = vocabulary.buffers()
            self.offsets = np.frombuffer(offsets, dtype=np.int32)[: len(vocabulary) + 1].astype(np.int64)
            self.data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        else:
            self.offsets, self.data = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        pairs = codes.astype(np.int64) * max(self.n, 1) + docs
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        self.held_from = np.searchsorted(pairs, np.arange(len(vocabulary) + 1) * max(self.n, 1))
        self.held_by = (pairs % max(self.n, 1)).astype(np.int32)
        pa.default_memory_pool().release_unused()

    def find(self, patterns: Sequence[bytes]) -> Runs:
        """(pattern, count, texts): the texts that contain each pattern, which follow each other by pattern; once each."""
        # a pattern without white space at its ends is sure to be where its core is
        names: list[bytes] = []
        number: dict[bytes, int] = {}
        sure, doubtful = [], defaultdict(list)
        spaced, blank = [], []
        for k, pattern in enumerate(patterns):
            words = pattern.split(None, 1)
            if not words:
                blank.append(k)
            elif len(words) > 1:
                spaced.append(k)
            else:
                core = pattern if len(words[0]) == len(pattern) else words[0]
                c = number.setdefault(core, len(names))
                if c == len(names):
                    names.append(core)
                    sure.append(-1)
                if len(core) == len(pattern):
                    sure[c] = k
                else:
                    doubtful[c].append(k)
        number.clear()
        pattern_of = np.array(sure, dtype=np.int64)
        parts: list[Runs] = []
        unsure: list[tuple[np.ndarray, np.ndarray]] = []
        for core, count, docs in self._by_word(names):
            ends = np.cumsum(count)
            for i in np.flatnonzero(np.isin(core, list(doubtful))).tolist() if doubtful else ():
                own = docs[ends[i] - count[i] : ends[i]]
                unsure += [(np.full(len(own), k, dtype=np.int64), own) for k in doubtful[int(core[i])]]
            known = pattern_of[core] >= 0
            if not known.all():
                docs = docs[stretches((ends - count)[known], count[known])]
                core, count = core[known], count[known]
            parts.append((pattern_of[core], count, docs))
        every = np.arange(self.n, dtype=np.int32)
        unsure += [(np.full(self.n, k, dtype=np.int64), every) for k in blank]
        unsure += self._by_windows({k: tuple(patterns[k].split(None, 3)[:3]) for k in spaced})
        if unsure:
            parts.append(self._verified(np.concatenate([k for k, _ in unsure]), np.concatenate([d for _, d in unsure]), patterns))
        listed = [[p[i] for p in parts] for i in range(3)]
        parts.clear()
        return tuple(concatenated(some, kind) for some, kind in zip(listed, (np.int64, np.int64, np.int32), strict=True))

    def _by_word(self, cores: list[bytes]) -> Iterator[Runs]:
        pairs = _within(self.data, self.offsets, cores)
        if not len(pairs):
            return
        word, core = (pairs & 0xFFFFFFFF).astype(np.int32), (pairs >> 32).astype(np.int32)
        del pairs
        first = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
        core = core[first].astype(np.int64)
        held = np.diff(self.held_from)
        total = np.add.reduceat(held[word], first)
        last = np.append(first[1:], len(word))
        often = total > self.n // _SPARSE
        marks = np.zeros(self.n, dtype=bool)
        listed, sizes = [], []
        for f, l in zip(first[often].tolist(), last[often].tolist(), strict=True):
            marks[:] = False
            marks[self.held_by[stretches(self.held_from[word[f:l]], held[word[f:l]])]] = True
            listed.append(np.flatnonzero(marks).astype(np.int32))
            sizes.append(len(listed[-1]))
        if listed:
            yield core[often], np.array(sizes, dtype=np.int64), concatenated(listed, np.int32)
        first, last, core = first[~often], last[~often], core[~often]
        ends, low = np.cumsum(total[~often]), 0
        while low < len(core):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _PAIRS, side="right")), low + 1)
            own = word[stretches(first[low:high], last[low:high] - first[low:high])]
            of = np.repeat(core[low:high], last[low:high] - first[low:high])
            pairs = np.repeat(of, held[own]) * self.n + self.held_by[stretches(self.held_from[own], held[own])]
            yield _runs(_distinct(pairs), self.n)
            low = high

    def _by_windows(self, split: dict[int, tuple[bytes, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(pattern, text): texts that have the first two or three words of a pattern in a row, the outer ones by their ends."""
        kinds = defaultdict(list)
        for k in split:
            first, last = split[k][0], split[k][-1]
            kinds[len(split[k]) > 2, min(len(first), 3) // 3 * 2 + 1, min(len(last), 3) // 3 * 2 + 1].append(k)
        middles = pa.array([split[k][1] for own in kinds.values() for k in own], pa.binary()).dictionary_encode()
        middle_of = dict(zip((k for own in kinds.values() for k in own), middles.indices.to_pylist(), strict=True))
        # of each word of the vocabulary: the number of what it is, ends with and starts with, or -1
        numbers = pc.index_in(self.vocabulary.cast(pa.binary()), value_set=middles.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        found = []
        for (three, before, after), own in kinds.items():
            starts = [int.from_bytes(split[k][0][-before:], "little") for k in own]
            ends = [int.from_bytes(split[k][2 if three else 1][:after], "little") for k in own]
            start_known, start_key = np.unique(starts, return_inverse=True)
            end_known, end_key = np.unique(ends, return_inverse=True)
            tails = self._numbered(before, True, start_known)
            heads = self._numbered(after, False, end_known)
            own, key = np.array(own), start_key.astype(np.int64) * len(end_known) + end_key
            last = 2 if three else 1
            if three:
                middle = np.array([middle_of[k] for k in own.tolist()], dtype=np.int64)
                here = np.zeros(len(middles.dictionary) + 1, dtype=bool)
                here[middle] = True
                between = np.where(here[numbers], numbers, -1)
                key += middle * (len(start_known) * len(end_known))
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order].astype(np.uint64)
            known, first = np.unique(key, return_index=True)
            table, first = _table(known), np.append(first, len(own))
            hits = []
            for low in range(0, len(self.codes) - last, _SLICE):
                codes, docs = self.codes[low : low + _SLICE + last], self.docs[low : low + _SLICE + last]
                start, end = tails[codes[:-last]], heads[codes[last:]]
                # a number that is -1 makes this negative
                valid = start | end
                if three:
                    middle = between[codes[1:-1]]
                    valid |= middle
                at = np.flatnonzero((valid >= 0) & (docs[:-last] == docs[last:]))
                seen = start[at].astype(np.int64) * len(end_known) + end[at]
                if three:
                    seen += middle[at].astype(np.int64) * (len(start_known) * len(end_known))
                hit, place = _looked_up(seen.astype(np.uint64), known, table)
                hits.append((at[hit] + low, place))
            at, place = (np.concatenate([np.zeros(0, dtype=np.int64), *(h[i] for h in hits)]) for i in range(2))
            counts = first[place + 1] - first[place]
            ends, low = np.cumsum(counts), 0
            first_words = _packed([split[k][0] for k in own.tolist()], True)
            last_words = _packed([split[k][last] for k in own.tolist()], False)
            while low < len(at):
                high = max(int(np.searchsorted(ends, ends[low] - counts[low] + _PAIRS, side="right")), low + 1)
                c = counts[low:high]
                i, window = stretches(first[place[low:high]], c), np.repeat(at[low:high], c)
                for tail, shift, (letters, mask) in ((True, 0, first_words), (False, last, last_words)):
                    same = ((self._eight(tail)[self.codes[window + shift]] ^ letters[i]) & mask[i]) == 0
                    i, window = i[same], window[same]
                pairs = _distinct(own[i] * np.int64(self.n) + self.docs[window])
                found.append((pairs // self.n, (pairs % self.n).astype(np.int32)))
                low = high
        return found

    def _eight(self, tail: bool) -> np.ndarray:
        """The last or the first eight bytes of each word of the vocabulary, zeros for what it is short of."""
        if tail not in self.eights:
            lengths = np.diff(self.offsets)
            ends = np.zeros(len(lengths), dtype=np.uint64)
            for i in range(8):
                long = np.flatnonzero(lengths > i)
                at = self.offsets[1:][long] - 1 - i if tail else self.offsets[:-1][long] + i
                ends[long] |= self.data[at].astype(np.uint64) << np.uint64(8 * i)
            self.eights[tail] = ends
        return self.eights[tail]

    def _numbered(self, size: int, tail: bool, known: np.ndarray) -> np.ndarray:
        """Of each word the place among ``known`` of its last or first ``size`` bytes as a number, or -1."""
        lengths = np.diff(self.offsets)
        long = np.flatnonzero(lengths >= size)
        at = self.offsets[1:][long] - size if tail else self.offsets[:-1][long]
        letters = sum(self.data[at + i].astype(np.int64) << 8 * i for i in range(size))
        place = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        numbers = np.full(len(lengths), -1, dtype=np.int32)
        numbers[long] = np.where(known[place] == letters, place, -1)
        return numbers

    def _verified(self, pattern: np.ndarray, docs: np.ndarray, patterns: Sequence[bytes]) -> Runs:
        """Of the pairs of pattern and text, those where the text contains the pattern."""
        order = np.argsort(docs, kind="stable")
        pattern, docs = pattern[order], docs[order]
        keep = np.zeros(len(docs), dtype=bool)
        cuts = np.searchsorted(docs, np.arange(self.n + 1)).tolist()
        base = 0
        for chunk in self.texts:
            for i, text in enumerate(chunk.cast(pa.binary()), base):
                low, high = cuts[i], cuts[i + 1]
                if low < high:
                    t = text.as_py()
                    keep[low:high] = [patterns[k] in t for k in pattern[low:high].tolist()]
            base += len(chunk)
        return _runs(_distinct(pattern[keep] * self.n + docs[keep]), self.n)


def concatenated(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """All parts in one array; each is let go when it has been copied."""
    whole = np.empty(sum(map(len, parts)), dtype=kind)
    end = len(whole)
    while parts:
        part = parts.pop()
        whole[end - len(part) : end] = part
        end -= len(part)
    return whole


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys once each and sorted; sorts them where they are."""
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _runs(pairs: np.ndarray, n: int) -> Runs:
    """Of sorted numbers pattern * n + text."""
    first, second = pairs // n, pairs % n
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else first
    return first[starts], np.diff(np.append(starts, len(first))), second.astype(np.int32)
