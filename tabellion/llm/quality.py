"""Quality classifier: support vectors on naive Bayes scaled n-gram indicators.

Every n-gram that occurs in a text is an indicator, scaled by the log ratio of its smoothed
frequencies in the two classes; a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent, and a logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabellion.llm.common import code_points, dual_descent, grams, labelled_sample, logistic, mixed, sigmoid

#: n-grams are hashed to so many bits
BITS = 16
#: default bound on the labelled documents that are learned from
SAMPLE_ROWS = 6000
_SPACE = np.zeros(1 << 16, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32, 133, 160]] = True


def _classes() -> np.ndarray:
    """One of six classes for each code point below 2 ** 16: lower, upper, digit, mark, line end, space."""
    kinds = np.zeros(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        kinds[code] = (
            4 if char == "\n" else 5 if char.isspace() else 2 if char.isdigit() else 1 if char.isupper() else
            0 if char.isalpha() else 3
        )
    return kinds


_KINDS: list[np.ndarray] = []


def ngrams(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of the whole text.

    1 to 3 characters; and 1 to 3 words as shapes: first and last kind of character, last
    two characters, length, and whether the word equals the one before it.
    """
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if not _KINDS:
        _KINDS.append(_classes())
    codes = np.minimum(code_points(text), 0xFFFF)
    seen = np.zeros(1 << BITS, dtype=bool)
    for values in grams(codes, (1, 2, 3)):
        seen[mixed(values, BITS)] = True
    blank = _SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        kinds = _KINDS[0][codes].astype(np.uint64)
        length = ends - starts
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(codes, 32), dtype=np.uint64)))
        digest = total[ends] - total[starts] + length.astype(np.uint64) * np.uint64(1 << 40)
        again = np.concatenate(([False], digest[1:] == digest[:-1])).astype(np.uint64)
        last, before = codes[ends - 1].astype(np.uint64), codes[np.maximum(ends - 2, starts)].astype(np.uint64)
        marked = np.where(kinds[ends - 1] == 3, last * 65536 + np.where(kinds[np.maximum(ends - 2, starts)] == 3, before, 0), 0)
        shape = kinds[starts] * 64 + kinds[ends - 1] * 8 + again * 4 + np.minimum(length // 4, 3).astype(np.uint64)
        for values in (shape, marked + 1):
            for n, runs in enumerate(grams(values, (1, 2, 3)), 11):
                seen[mixed(runs * np.uint64(64) + np.uint64(n), BITS)] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    """Weights per n-gram (ratios and support vectors multiplied out), ratios, and the score curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum() / max(1e-9, np.sqrt(np.square(self.ratios[found]).sum()))) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(np.array(self.slope * self.margin(found) + self.offset)))


def _fit(found: list[np.ndarray], labels: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    size = 1 << BITS
    counts = [np.ones(size), np.ones(size)]
    for index, label in zip(found, labels, strict=True):
        counts[label][index] += 1
    positive, negative = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    ratios = np.log(positive / negative)
    rows = []
    for index in found:
        values = ratios[index]
        norm = max(1e-9, np.sqrt(np.square(values).sum()))
        rows.append((np.append(index, size), np.append(values / norm, 1.0)))
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    weights = dual_descent(rows, signs, size + 1, cost * 0.5 / share)
    return weights[:size] * ratios, ratios, float(weights[size])


def fit(found: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """Fits the model; margins for the score curve come from rows that were not fitted on (two halves).

    With a single class every score is that class; without rows every score is 1.
    """
    labels = np.asarray(labels, dtype=int)
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        value = float(labels[0]) if len(labels) else 1.0
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, 20.0 if value else -20.0)
    half = np.zeros(len(labels), dtype=int)
    for label in (0, 1):
        half[np.flatnonzero(labels == label)[::2]] = 1
    margins = np.zeros(len(labels))
    for part in (0, 1):
        learn = np.flatnonzero(half != part)
        if len(set(labels[learn].tolist())) < 2:
            learn = np.arange(len(labels))
        held = Model(*_fit([found[i] for i in learn], labels[learn], cost), 1.0, 0.0)
        for i in np.flatnonzero(half == part):
            margins[i] = held.margin(found[i])
    slopes, offset = logistic(margins[:, None], labels)
    return Model(*_fit(found, labels, cost), float(slopes[0]), offset)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents, whose n-grams come to the driver (bounded)."""

    @F.pandas_udf(T.BinaryType())
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([ngrams(t).tobytes() for t in texts], dtype=object)

    sample = labelled_sample(docs, labels, label, learn, rows).select("label", found("text").alias("found")).collect()
    sample.sort(key=lambda r: (r.label, bytes(r.found)))
    return fit([np.frombuffer(r.found, dtype=np.uint32) for r in sample], np.array([r.label for r in sample], dtype=int))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: the score from 0 to 1 of each whole text; null counts as empty.

    The column is replaced if there. The model, of a fixed size, travels with the function.
    """
    packed = Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias, model.slope, model.offset)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([packed.score(ngrams(t)) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(F.col(text)))
