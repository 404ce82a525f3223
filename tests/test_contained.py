import random

import numpy as np
import pyarrow as pa
import pytest

from tabellion.operators import contained


@pytest.mark.parametrize("limits", [(1 << 19, 1 << 20, 64), (7, 5, 2)])
def test_patterns_are_found_where_they_are(monkeypatch, limits):
    for name, value in zip(("_SLICE", "_PAIRS", "_SPARSE"), limits, strict=True):
        monkeypatch.setattr(contained, name, value)
    rng = random.Random(3)
    words = ["a", "an", "banana", "ana", "né", "ée", "日本語", "x" * 30, "x" * 17 + "y", "theory", "the", "\u00a0of", "of", "0", "a\x00b"]
    texts = ["".join(w + rng.choice([" ", "  ", "\n", "\t ", ". "]) for w in rng.choices(words, k=rng.randrange(9))) for _ in range(80)] + ["", " "]
    patterns = {"", " ", "\n", "x" * 9, "x" * 16 + "y", "xy", "ana", " the", "the ", "a an", "an  a", "n a", "é", "本", "語 日", "the\ttheory", "b", "o", "of. the", "zz", "zz of", "\x00"}
    for _ in range(150):
        text = rng.choice(texts)
        at = rng.randrange(len(text) + 1)
        patterns.add(text[at : at + rng.randrange(1, 30)])
    patterns = sorted(patterns)
    chunks = pa.chunked_array([texts[:30], texts[30:30], texts[30:]], pa.string())
    pattern, count, found = contained.Texts(chunks).find([p.encode() for p in patterns])
    assert len(set(pattern.tolist())) == len(pattern) and count.sum() == len(found)
    got = dict(zip(pattern.tolist(), (sorted(f.tolist()) for f in np.split(found, np.cumsum(count)[:-1])), strict=True))
    for k, p in enumerate(patterns):
        assert got.get(k, []) == [i for i, t in enumerate(texts) if p in t], repr(p)


def test_no_texts_or_no_patterns():
    for texts, patterns in (([], [b"a", b"a b", b""]), (["a b"], []), (["", " "], [b"a", b"a b"])):
        pattern, count, found = contained.Texts(pa.chunked_array([texts], pa.string())).find(patterns)
        assert len(pattern) == len(count) == len(found) == 0
