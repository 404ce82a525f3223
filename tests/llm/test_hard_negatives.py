import random

import numpy as np
from pyspark.sql import functions as F

from tabellion.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor_id string"


def plain(rows, is_anchor, count=5, share=(80, 100)):
    """Every anchor against every row."""
    usable = {}
    for key, vector, label, *_ in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        values = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        usable[key] = min(usable.get(key, (label, values)), (label, values))

    def score(a, b):
        return sum(x * y for x, y in zip(usable[a][1], usable[b][1], strict=False))

    out = set()
    for anchor in filter(is_anchor, usable):
        own = usable[anchor][0]
        same = sorted((-score(anchor, k), k) for k in usable if k != anchor and usable[k][0] == own)[:count]
        other = sorted((-score(anchor, k), k) for k in usable if usable[k][0] != own)
        for top, positive in same:
            fits = [(s, k) for s, k in other if share[0] * -top <= share[1] * -s <= share[1] * -top][:count]
            out |= {(anchor, positive, i + 1, k, -top, -s) for i, (s, k) in enumerate(fits)}
    return out


def mined(spark, rows, every, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.mine(frame, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in found.collect()]


def table(count, clusters=12, dims=8, seed=1):
    random.seed(seed)
    centres = [[random.gauss(0, 0.3) for _ in range(dims)] for _ in range(clusters)]
    return [
        (i, [c + random.gauss(0, 0.03) for c in random.choice(centres)], random.randrange(4), "x", "y") for i in range(count)
    ]


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 5)
    monkeypatch.setattr(hard_negatives, "FANOUT", 2)
    monkeypatch.setattr(hard_negatives, "PAGE", 3)
    rows = table(700)
    found = mined(spark, rows, 20)
    assert len(found) == len(set(found))
    assert set(found) == plain(rows, lambda k: k % 20 == 0)


def test_copies_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 10)
    nan, inf = float("nan"), float("inf")
    rows = table(150)
    hot = [0.3] * 8
    rows += [(1000 + i, hot, i % 2, None, None) for i in range(120)]
    rows += [(2000, None, 1, "x", "y"), (2010, [nan] * 8, 1, "x", "y"), (2020, [inf] + [0.1] * 7, 1, "x", "y")]
    rows += [(2030, [None] + [0.1] * 7, 1, "x", "y"), (2040, hot, None, "x", "y"), (None, hot, 1, "x", "y")]
    rows += [(2050, [0.5, 0.2], 1, "x", "y"), (2060, [], 2, "x", "y"), (2070, [0.0] * 8, 2, "x", "y")]
    rows += [(1000, hot, 0, "x", "y"), (1000, hot, 3, "x", "y"), (10, hot, 9, "x", "y")]
    assert set(mined(spark, rows, 10)) == plain(rows, lambda k: k % 10 == 0)


def test_huge_components_are_exact(spark):
    rows = [(i, [1e14 * (i % 7 + 1), float(i % 3), 1e-3 * i], i % 2, "x", "y") for i in range(60)]
    assert set(mined(spark, [(k, [v[1], v[2]], *r) for k, v, *r in rows], 10)) == plain(
        [(k, [v[1], v[2]], *r) for k, v, *r in rows], lambda k: k % 10 == 0
    )
    large = [(k, [np.float32(3e6) * v[1], v[2]], *r) for k, v, *r in rows]
    large = [(k, [float(x) for x in v], *r) for k, v, *r in large]
    assert set(mined(spark, large, 10)) == plain(large, lambda k: k % 10 == 0)
    assert mined(spark, [(k, [v[0] * 1e20, v[1]], *r) for k, v, *r in rows], 10)  # beyond 64 bits: cut, no failure


def test_few_rows_and_none(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [0.5], 1, "x", "y")], 10) == []
    rows = [(0, [0.5, 0.5], 1, "x", "y"), (1, [0.5, 0.4], 1, "x", "y"), (2, [0.5, 0.4], 2, "x", "y")]
    assert mined(spark, rows, 10) == [(0, 1, 1, 2, 128 * 128 + 128 * 102, 128 * 128 + 128 * 102)]


def test_boxes_bound_the_scores_and_prune():
    draw = np.random.default_rng(3)
    rows = draw.integers(-200, 200, (5, 1, 6)) + draw.integers(-5, 5, (5, 300, 6))
    vectors = rows.reshape(-1, 6).astype(np.int64)
    at = hard_negatives.packed(vectors, np.arange(4))
    assert sorted(at) == list(range(len(vectors)))
    tree = hard_negatives.Tree(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), vectors[at])
    queries = vectors[::100].astype(float)
    exact = queries @ vectors[at].T
    low, high = tree.bounds(queries)[0]
    for leaf in range(low.shape[1]):
        part = exact[:, leaf * hard_negatives.LEAF_ROWS : (leaf + 1) * hard_negatives.LEAF_ROWS]
        assert (low[:, [leaf]] <= part).all() and (part <= high[:, [leaf]]).all()
    seen = []
    original = tree.scores
    tree.scores = lambda q, a, b: seen.append(a) or original(q, a, b)
    mine = [(a[0], b[0]) for a, b in tree.bounds(queries)]
    tree.search(queries[0].astype(np.int64), 0, [(-hard_negatives.LIMIT, hard_negatives.LIMIT)], [-hard_negatives.LIMIT], 5, True, mine)
    assert len(seen) < low.shape[1]
