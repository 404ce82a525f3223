"""Language identification: script ranges, word scores, and Viterbi spans.

The script of a word narrows its candidate languages to those written in it. A word's score
for a language is the smoothed log probability of its character n-grams, averaged over their lengths. Over the words of a
text the best sequence of languages is found by Viterbi with a fixed penalty for each switch;
runs of one language are the spans, and the language with the most letters is the text's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import grams, mixed

#: n-grams are hashed to so many bits
BITS = 15
SIZES = (1, 2, 3)
#: log-probability that a change of language costs
PENALTY = 10.0
#: a language is a candidate for a script if it has at least this share of its learned letters in it
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the runs of letters of a text are. Numerals such as ½, ² and Ⅷ match as word characters, but are no letters."""
    spans = []
    for match in _WORD.finditer(text):
        start, end = match.span()
        if text[start:end].isalpha():
            spans.append((start, end))
            continue
        for letters, run in groupby(range(start, end), key=lambda i: text[i].isalpha()):
            if letters:
                places = list(run)
                spans.append((places[0], places[-1] + 1))
    return spans


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else [text[i:j] for i, j in word_spans(text)]


#: fixed values: first code points of script ranges (public Unicode blocks, merged); letters
#: of a range share a script number, 0 stands for any other
SCRIPT_STARTS = [
    0x0041, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80,
    0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1E00, 0x1F00,
    0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900,
]
SCRIPT_NUMBERS = [
    1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12,
    13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 1, 2,
    25, 25, 0, 26, 0, 22, 0, 26,
]
SCRIPTS = 27


def script(letter: str) -> int:
    place = bisect_right(SCRIPT_STARTS, ord(letter)) - 1
    return SCRIPT_NUMBERS[place] if place >= 0 else 0


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, with word bounds, and for each the number of its word."""
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    number = np.cumsum(codes == 32) - 1
    found, owner = [], []
    for n, values in zip(SIZES, grams(codes, SIZES), strict=False):
        first, last = codes[: len(values)], codes[n - 1 :]
        # a run belongs to the word it starts in or before; it may end with the blank after it
        keep = (number[n - 1 :] - number[: len(values)] <= (last == 32)) & ((first != 32) | (n > 1))
        found.append(mixed(values[keep], BITS))
        owner.append(number[: len(values)][keep])
    found, owner = np.concatenate(found), np.concatenate(owner)
    return found[owner < len(words)], owner[owner < len(words)]


@dataclass
class Model:
    """Languages, log probability per (n-gram, language), candidates per script, and the penalty."""

    langs: list[str]
    table: np.ndarray
    candidates: np.ndarray
    penalty: float = PENALTY

    def word_scores(self, words: list[str]) -> np.ndarray:
        words = [w.lower() for w in words]
        found, owner = word_grams(words)
        out = np.empty((len(words), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(owner, self.table[found, i], len(words)) / len(SIZES)
        out[~self.candidates[[script(w[0]) for w in words]]] = -1e6
        return out

    def path(self, scores: np.ndarray) -> np.ndarray | int:
        """The best language number for each word, or one number if it is the same for all.

        If no run of words gains more than half of the penalty by any other language, no
        switch can pay (r runs need r - 1 switches at least, and the language with the
        largest sum gains most by one run over all words); that is seen from running sums,
        without stepping through the words.
        """
        best = int(scores.sum(axis=0).argmax())
        gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        least = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
        if (gain - least).max() <= self.penalty / 2:
            return best
        total, before = scores[0].tolist(), []
        everything = range(len(total))
        for row in scores[1:].tolist():
            top = max(everything, key=total.__getitem__)
            jump = total[top] - self.penalty
            before.append([i if total[i] >= jump else top for i in everything])
            total = [max(total[i], jump) + row[i] for i in everything]
        state = max(everything, key=total.__getitem__)
        labels = [state]
        for step in reversed(before):
            state = step[state]
            labels.append(state)
        return np.array(labels[::-1])

    def predict(self, texts: list[str | None], known: Words) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per text its language, the share of letters in that language, and the spans.

        A span is (first, end, language) in characters of the text.
        """
        found = [words_of(t) if t else [] for t in texts]
        known.learn(found, self)
        out = []
        for text, words in zip(texts, found, strict=True):
            if not words or not self.langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            path = self.path(known.scores(words))
            if isinstance(path, int):
                end = text.rindex(words[-1]) + len(words[-1])
                out.append((self.langs[path], 1.0, [(text.index(words[0]), end, self.langs[path])]))
                continue
            at = word_spans(text)
            letters = np.bincount(path, list(map(len, words)), len(self.langs))
            best = int(letters.argmax())
            turns = (np.flatnonzero(np.diff(path)) + 1).tolist()
            bounds = zip([0, *turns], [*turns, len(path)], strict=True)
            spans = [(at[a][0], at[b - 1][1], self.langs[path[a]]) for a, b in bounds]
            out.append((self.langs[best], float(letters[best] / letters.sum()), spans))
        return out


class Words:
    """Word scores remembered by a task, up to a bound; then it starts anew."""

    def __init__(self, most: int = 400_000):
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.most = most

    def learn(self, texts: list[list[str]], model: Model) -> None:
        new = set().union(*texts).difference(self.number)
        if len(self.number) + len(new) > self.most:
            self.number, self.rows = {}, []
            new = set().union(*texts)
        if new and model.langs:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.rows.append(model.word_scores(list(new)))
            if len(self.rows) > 1:
                self.rows = [np.concatenate(self.rows)]

    def scores(self, words: list[str]) -> np.ndarray:
        return self.rows[0][np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]


def counted(texts: Iterable[str]) -> np.ndarray:
    """How often each hashed n-gram occurs in the texts, then the letters of each script."""
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update(words_of(text.lower()))
    out = np.zeros((1 << BITS) + SCRIPTS, dtype=np.int64)
    if seen:
        words, times = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        found, owner = word_grams(words)
        out[: 1 << BITS] = np.bincount(found, times[owner], 1 << BITS)
        letters = times * np.fromiter(map(len, words), np.int64, len(words))
        out[1 << BITS :] = np.bincount([script(w[0]) for w in words], letters, SCRIPTS)
    return out


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", penalty: float = PENALTY) -> Model:
    """A model counted over all rows that meet ``learn`` and have text and language.

    Each task counts its own rows per language in tables of a fixed size; the sums per
    language (2 ** BITS n-grams and the scripts) come to the driver. Languages are few: a
    table of counts each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, texts in batch.groupby("lang")["text"]:
                total = counts.setdefault(language, np.zeros((1 << BITS) + SCRIPTS, dtype=np.int64))
                for at in range(0, len(texts), 1000):
                    total += counted(texts.iloc[at : at + 1000])
        for language, total in counts.items():
            place = np.flatnonzero(total)
            yield pd.DataFrame({"lang": language, "place": place.astype("int32"), "n": total[place]})

    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = (
        rows.mapInPandas(count, "lang string, place int, n long")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("place", "n")).alias("counts"))
        .toArrow()
    )
    langs = sorted(sums.column("lang").to_pylist())
    counts = np.zeros((len(langs), (1 << BITS) + SCRIPTS))
    for language, pairs in zip(sums.column("lang").to_pylist(), sums.column("counts"), strict=True):
        values = pairs.values
        counts[langs.index(language), values.field("place").to_numpy()] = values.field("n").to_numpy()
    return fit(langs, counts, penalty)


def fit(langs: list[str], counts: np.ndarray, penalty: float = PENALTY) -> Model:
    """A model from counts per language: n-grams, then letters per script.

    A script that no language is known to use leaves all languages as candidates.
    """
    seen = counts[:, : 1 << BITS] + 0.5
    table = np.log(seen / seen.sum(axis=1, keepdims=True, initial=1e-9)).T
    scripts = counts[:, 1 << BITS :]
    candidates = (scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE).T
    candidates[~candidates.any(axis=1)] = True
    return Model(langs, table.astype(np.float32), candidates, penalty)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and spans of each whole text (columns of these names are replaced).

    The score is the share of the letters that the spans of ``lang_pred`` hold; a null text
    or one without a letter is ``und`` with score 0 and no span.
    """
    kind = "struct<lang: string, score: double, spans: array<struct<first: int, end: int, lang: string>>>"

    @F.pandas_udf(kind)
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts in batches:
            rows = []
            for at in range(0, len(texts), 1000):
                rows += model.predict(texts.iloc[at : at + 1000].tolist(), known)
            spans = [[{"first": a, "end": b, "lang": c} for a, b, c in r[2]] for r in rows]
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": spans})

    return (
        docs.withColumn("_found", identified(F.col(text)))
        .withColumn("lang_pred", F.col("_found.lang"))
        .withColumn("score", F.col("_found.score"))
        .withColumn("spans", F.col("_found.spans"))
        .drop("_found")
    )
