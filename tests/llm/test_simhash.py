import random

import xxhash
from pyspark.sql import functions as F

from tabellion.llm import simhash
from tabellion.llm.common import components

SCHEMA = "doc_id long, text string, fingerprint string, component_id string"


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            bits |= 1 << bit
    return bits


def plain_components(codes, distance):
    ids = sorted(codes)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(codes[a] ^ codes[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40, 90]))]
        out.append((i, " ".join(words)))
        if i % 4 == 0 and len(words) > 30:  # near copies in a chain, and an exact copy
            for k in range(1, 4):
                words[rng.randrange(len(words))] = "X"
                out.append((1000 + 10 * i + k, "\t".join(words).upper()))
            out.append((5000 + i, " ".join(words)))
    return [*out, (9001, None), (9002, ""), (9003, " "), (9004, "long " * 70_000), (9005, "ÀB c\x0bd\x1ce F")]


def test_matches_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "mine", "mine") for i, t in data], SCHEMA)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    codes = {i: plain_fingerprint(t) for i, t in data}
    assert {i: r.fingerprint & (2**64 - 1) for i, r in found.items()} == codes
    assert {i: r.component_id for i, r in found.items()} == plain_components(codes, 3)


def test_other_distances(spark):
    codes = {i: simhash.fingerprint(f"a b c d {i % 7} e f g {i % 5}") & (2**64 - 1) for i in range(60)}
    rng = random.Random(1)
    for i in range(60, 200):
        codes[i] = codes[i % 60] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))
    distinct = sorted(set(codes.values()))
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in distinct]
    frame = spark.createDataFrame(signed, "code long")
    for distance, segments in ((5, 4), (6, 3), (1, 1)):
        pairs = simhash.hamming_pairs(frame, distance // segments, segments, 64, distance).collect()
        got = sorted(tuple(sorted(((r.left_code, r.right_code)))) for r in pairs)
        want = sorted(
            tuple(sorted((a, b)))
            for i, (a,) in enumerate(signed)
            for (b,) in signed[i + 1 :]
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance
        )
        assert got == want and want


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "z"), (4, "a b c"), (4, "a b c"), (2, "q r s t")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 2, 2), (False, 4, 4), (False, 4, 4), (True, 0, -1), (True, 0, 4)]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(1049, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{1000 + i: 7 for i in range(50)}, 7: 7, 300: 7}
