import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tabellion.llm import decontamination as d


def plain_tiles(pattern, text, least):
    """Greedy string tiling by trying all places, longest match first."""
    marked, taken, tiles = [False] * len(pattern), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(pattern)):
            for j in range(len(text)):
                n = 0
                while (
                    i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n]
                    and text[j + n] and not marked[i + n] and not taken[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        marked[i : i + n] = [True] * n
        taken[j : j + n] = [True] * n
        tiles.append(n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(0, 4), max_size=22), st.integers(1, 4))
def test_tiling_matches_the_plain_algorithm(pattern, text, least):
    import numpy as np

    got = d.tile(np.array(pattern, dtype=int), list(text), least) if pattern else []
    assert got == (plain_tiles(pattern, text, least) if pattern else [])


def test_planted_passages(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(f"n{rng.randrange(400)}" for _ in range(n))
    items = [(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(30)] + [(90, "Short one"), (91, ""), (92, None), (93, "b0x1 b0x2")]
    words = items[3][1].split()
    docs = [
        (1, noise(50) + " " + items[0][1].upper() + "! " + noise(30)),
        (2, noise(10) + " " + " ".join(words[10:]) + " " + noise(5) + " " + " ".join(words[:10])),  # reordered
        (3, noise(20) + " " + " ".join(items[4][1].split()[:12])),  # 0.6 of it
        (4, noise(200)),
        (5, "x short, ONE y"),
        (6, None),
        (7, ""),
        (8, ", ".join(items[5][1].split()[:17]) + " " + noise(60_000)),
        (1, items[1][1]),
        (None, items[2][1]),
    ]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id or 0), r.item_id, round(r.coverage, 2)) for r in d.matches(frame, bench).collect())
    assert got == [(0, 2, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 93, 1.0), (2, 3, 1.0), (5, 90, 1.0), (8, 5, 0.85)]
    kept = d.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]


def test_clean_rows_stay_beside_leaked_ones_of_their_key(spark):
    leak = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame(
        [(None, leak), (None, "clean one"), (None, None), (1, "so " + leak), (1, "clean two"), (2, leak), (2, "")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(5, leak)], "item_id long, text string")
    kept = d.decontaminate(docs, bench).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, ""), (0, "clean one"), (1, "clean two"), (2, "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.matches(docs, bench).count() == 0
    assert d.matches(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert d.decontaminate(some, bench).count() == 1


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(8))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(10 + i, t) for i, t in items], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()) == [(10 + i, i) for i in range(5)]
