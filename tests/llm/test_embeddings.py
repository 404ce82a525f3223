import numpy as np

from tabellion.llm import embeddings


def brute(vectors, cosine=0.95):
    ids = list(vectors)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            x, y = np.array(vectors[a], float), np.array(vectors[b], float)
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = {}
    for i in range(150):
        base = rng.standard_normal(24)
        vectors[i * 10] = base
        for k in range(1, 4 if i % 5 == 0 else 1):
            vectors[i * 10 + k] = base + rng.standard_normal(24) * 0.25 * k
        if i % 7 == 0:
            vectors[i * 10 + 8], vectors[i * 10 + 9] = base, base * 3
    vectors[5000], vectors[5001] = np.array([1.0, 0, 2]), np.array([1.0, 0, 2.01])
    odd = {9000: None, 9001: [], 9002: [0.0] * 24, 9003: [None] + [1.0] * 23, 9004: [float("nan")] + [1.0] * 23, 9005: [float("inf")] * 24}
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 7) for i, v in [*vectors.items(), *odd.items()]]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n_links long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    single = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    want = {**brute(single), **{i: (0, i) for i in odd}}
    found = sum(n for n, _ in got.values())
    assert found >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert {i: got[i] for i in odd} == {i: want[i] for i in odd}


def test_one_group_of_copies_and_empty(spark):
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(None, [5.0, 1.0])], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(copies).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {(49, 0, True), (49, 0, False)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(blank).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}


def test_rotation_is_orthogonal_and_lowers_the_loss():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((500, 16)) @ np.diag(np.linspace(3, 0.2, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    first, last = (embeddings.learn_rotation(unit, 16, rounds) for rounds in (0, 50))
    assert np.allclose(last.projection.T @ last.projection, np.eye(16))

    def loss(r):
        values = (unit - r.mean) @ r.projection
        return np.square(np.where(values > 0, 1, -1) * np.abs(values).mean() - values).sum()

    assert loss(last) < loss(first)


def test_no_size_loses_links(spark):
    """Pairs just above the threshold, in tables laid out for so many vectors that 3 and 2 segments are left."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = rng.standard_normal(base.shape)
    across -= (across * base).sum(axis=1, keepdims=True) * base
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * across
    rows = [(i, 1, 64, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    nodes = spark.createDataFrame(rows, "least long, size long, width int, vector array<double>").cache()
    for count, segments in ((3000, 6), (1_000_000, 3), (120_000_000, 2)):
        assert embeddings.plan(nodes, count=count).segments == segments
        got = [(min(r.left, r.right), max(r.left, r.right)) for r in embeddings.links(nodes, count=count).collect()]
        assert len(got) == len(set(got))
        assert len(set(got) & {(i, 1500 + i) for i in range(1500)}) >= 0.993 * 1500


def test_tables_keep_the_missed_share():
    missed = []
    for count in (2, 10_000, 300_000, 1_000_000, 50_000_000, 117_000_000, 10**10):
        segments, width, rotations = embeddings.tables(count, 64, 0.101)
        caught = sum(embeddings.comb(width, k) * 0.101**k * 0.899 ** (width - k) for k in range(embeddings.RADIUS + 1))
        missed.append((1 - caught) ** (segments * rotations))
    assert max(missed) <= embeddings.MISSED
