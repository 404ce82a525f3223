"""Toxicity: a support vector machine over a gappy subsequence kernel with Nyström landmarks.

A sentence is seen as its windows: words without their punctuation, and runs of very short
words joined ("i d i o t"). Two windows are compared by the kernel that counts their common
subsequences of three characters, each weighted down for every character it skips, so that
"idxiot" or "i-diot" stays close to "idiot". Landmark windows span the feature space
(K(x, L) K(L, L)^-1/2). A document's label holds for some sentence of it only, so the machine
is trained by turns: the best window of each toxic sentence set is its witness, the best
windows of harmless sentences are counter-examples. A text scores by its three best
windows, as one rare word may look like an insult.

Summed over the landmarks, the decision function is linear in the subsequences; scoring uses
those sums, which gives the kernel machine's exact values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import dual_descent, labelled_sample, logistic, sigmoid

#: default bound on the labelled documents that are learned from
SAMPLE_ROWS = 4000
LANDMARKS = 96
#: characters of a subsequence, how many it may skip in all, and the factor for each skipped
ORDER, SKIPS, DECAY = 3, 2, 0.6
#: longer windows are read in pieces of this length that overlap by half
LONGEST = 32
#: scores remembered per task before it starts anew
REMEMBERED = 300_000
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[\W_]+")


def windows(text: str | None) -> set[str]:
    """The distinct windows of all sentences of a text, lower-cased."""
    found: set[str] = set()
    run: list[str] = []
    for token in (text or "").lower().split():
        word = token if token.isalnum() else _MARK.sub("", token)
        if len(word) <= 2:
            if word:
                run.append(word)
            if token[-1] not in ".!?":
                continue
        if len(run) > 2:
            found.update(pieces("".join(run)))
        run.clear()
        if len(word) > LONGEST:
            found.update(pieces(word))
        elif word:
            found.add(word)
    if len(run) > 2:
        found.update(pieces("".join(run)))
    return found


def pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of each length: their positions, subsequence codes, weights, and feature norms."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, all_rows in by_length.items():
        size = length + 2
        order = min(ORDER, size)
        places = np.array(
            [(i, *rest) for i in range(size) for rest in combinations(range(i + 1, min(size, i + order + SKIPS)), order - 1)]
        )
        weight = DECAY ** (places[:, -1] - places[:, 0] - order + 1).astype(float)
        step = max(1, 4_000_000 // len(places) ** 2)
        for at in range(0, len(all_rows), step):
            rows = np.array(all_rows[at : at + step])
            text = "".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass")
            codes = np.empty((len(rows), size), dtype=np.int64)
            codes[:, 0], codes[:, -1] = 2, 3
            codes[:, 1:-1] = np.frombuffer(text, dtype="<u4").reshape(len(rows), length)
            found = np.zeros((len(rows), len(places)), dtype=np.int64)
            for place in places.T:
                found = (found << 15) | (codes[:, place] & 0x7FFF)
            same = found[:, :, None] == found[:, None, :]
            yield rows, found, weight, np.sqrt(np.einsum("nij,i,j->n", same, weight, weight))


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel values of two lists of windows."""
    basis, table, norms = _basis(right)
    out = np.zeros((len(left), len(right)))
    for rows, found, weight, norm in subsequences(left):
        place = np.minimum(np.searchsorted(basis, found), len(basis) - 1)
        hit = basis[place] == found
        for n in range(found.shape[1]):
            out[rows] += np.where(hit[:, n, None], table[place[:, n]], 0.0) * weight[n]
        out[rows] /= norm[:, None]
    return out / norms


def _basis(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted subsequence codes of ``words``, their weights per word, and the norms."""
    parts = list(subsequences(words))
    basis = np.unique(np.concatenate([found.ravel() for _, found, _, _ in parts]))
    table, norms = np.zeros((len(basis), len(words))), np.ones(len(words))
    for rows, found, weight, norm in parts:
        for n in range(found.shape[1]):
            np.add.at(table, (np.searchsorted(basis, found[:, n]), rows), weight[n])
        norms[rows] = norm
    return basis, table, norms


@dataclass
class Model:
    """Summed weight per subsequence of the landmarks, bias, and the score curve."""

    basis: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        if len(self.basis):
            for rows, found, weight, norm in subsequences(words):
                place = np.minimum(np.searchsorted(self.basis, found), len(self.basis) - 1)
                out[rows] = (np.where(self.basis[place] == found, self.weights[place], 0.0) @ weight) / norm
        return out + self.bias

    def scores(self, texts: Iterable[str | None], known: dict[str, float]) -> np.ndarray:
        """Score of each text by its best window; ``known`` remembers margins of windows."""
        found = [windows(t) for t in texts]
        new = list(set().union(*found).difference(known)) if found else []
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*found))
        known.update(zip(new, self.margins(new).tolist(), strict=True))
        best = np.array([strongest([known[i] for i in w]) for w in found], dtype=float).reshape(-1, 3)
        return sigmoid(best @ self.slopes + self.offset)


def strongest(margins: list[float]) -> list[float]:
    """The three best margins, cut off at -1.5 (also for windows that are not there)."""
    return [max(-1.5, m) for m in nlargest(3, [*margins, -1.5, -1.5, -1.5])]


def _fit(bags: list[list[int]], labels: np.ndarray, words: list[str], rounds: int = 5):
    """Basis, weights and bias from bags of window numbers."""
    count = [Counter(i for b in (bags[k] for k in np.flatnonzero(labels == y)) for i in b) for y in (0, 1)]
    total = [(labels == y).sum() + 1.0 for y in (0, 1)]
    odds = np.full(len(words), -9.0)
    for i, n in count[1].items():
        if n >= 2:
            odds[i] = np.log((n + 0.1) / total[1]) - np.log((count[0][i] + 0.5) / total[0])
    ranked = sorted(count[1], key=lambda i: (-odds[i] * np.log1p(count[1][i]), words[i]))[: LANDMARKS * 2 // 3]
    common = sorted(count[0], key=lambda i: (-count[0][i], words[i]))
    landmarks = [words[i] for i in dict.fromkeys(ranked + common)][:LANDMARKS]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.empty((len(words), keep.sum() + 1), dtype=np.float32)
    for at in range(0, len(words), 20_000):
        features[at : at + 20_000, :-1] = kernel(words[at : at + 20_000], landmarks) @ root
    features[:, -1] = 1.0
    margin, everything, hard = odds, np.arange(features.shape[1]), set()
    spread = np.random.default_rng(5)
    harmless = np.array(sorted(count[0]), dtype=int)
    for _ in range(rounds):
        witness = Counter()
        for k in np.flatnonzero(labels == 1):
            if bags[k]:
                best = nlargest(3, bags[k], key=lambda i: (margin[i], i))
                witness.update(i for n, i in enumerate(best) if not n or margin[i] > 0)
        for k in np.flatnonzero(labels == 0):
            hard.update(sorted(bags[k], key=lambda i: -margin[i])[:3])
        hard.update(spread.choice(harmless, min(len(harmless), 1000), replace=False).tolist() if len(harmless) else [])
        chosen = sorted(witness) + sorted(hard)
        signs = np.array([1.0] * len(witness) + [-1.0] * len(hard))
        # a window that is as common in harmless documents weighs against being a witness
        cost = np.array([min(60.0, 3.0 * witness[i]) for i in sorted(witness)] + [min(60.0, 2.0 * count[0][i]) for i in sorted(hard)])
        weights = dual_descent([(everything, features[i].astype(float)) for i in chosen], signs, len(everything), cost, 40)
        margin = features @ weights
    basis, table, norms = _basis(landmarks)
    return basis, (table / norms) @ (root @ weights[:-1]), float(weights[-1])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Fits the machine; the score curve is fitted on margins of halves that were left out.

    Without toxic examples (or without others) every score is that of the only class.
    """
    labels = np.asarray(labels, dtype=int)
    found = [windows(t) for t in texts]
    if len(set(labels.tolist())) < 2 or not any(found):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros(3), 20.0 if len(labels) and labels.all() else -20.0)
    words = sorted(set().union(*found))
    number = {w: i for i, w in enumerate(words)}
    bags = [sorted(number[w] for w in ws) for ws in found]
    half = np.zeros(len(labels), dtype=int)
    for label in (0, 1):
        half[np.flatnonzero(labels == label)[::2]] = 1
    best = np.zeros((len(labels), 3))
    for part in (0, 1):
        learn = np.flatnonzero(half != part)
        if len(set(labels[learn].tolist())) < 2:
            learn = np.arange(len(labels))
        margin = Model(*_fit([bags[i] for i in learn], labels[learn], words), np.zeros(3), 0.0).margins(words)
        for i in np.flatnonzero(half == part):
            best[i] = strongest(margin[bags[i]].tolist())
    return Model(*_fit(bags, labels, words), *logistic(best, labels))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> Model:
    """A machine from at most ``rows`` labelled documents, which come to the driver as sets of windows."""

    @F.pandas_udf(T.StringType())
    def seen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: "\n".join(sorted(w for w in windows(t) if len(w) > 2)))

    sample = labelled_sample(docs, labels, label, learn, rows).select("label", seen("text").alias("seen")).collect()
    sample.sort(key=lambda r: (r.label, r.seen))
    return fit([r.seen for r in sample], np.array([r.label for r in sample], dtype=int))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: the score from 0 to 1 of each whole text; null and empty texts score lowest.

    The column is replaced if there. The machine, of a fixed size, travels with the function.
    """

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            parts = [model.scores(texts.iloc[i : i + 500], known) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]), dtype="float64")

    return docs.withColumn(name, scored(F.col(text)))
