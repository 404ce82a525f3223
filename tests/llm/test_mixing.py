import math
from hashlib import md5

from pyspark.sql import functions as F

from tabellion.llm import mixing


def plain_count(key, mean, seed=1):
    def draw(text, mean):
        chance = int(md5(text.encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-mean)
        while total <= chance and k < 48:
            k += 1
            total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        return k

    if mean <= 8:
        return draw(f"{seed}|{key}", mean)
    parts = math.ceil(mean / 8)
    return sum(draw(f"{seed}|{key}|{i}", mean / parts) for i in range(1, parts + 1))


def test_counts_follow_the_distribution(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else ("b" if i % 2 else None), "x") for i in range(6000)] + [(7000, None, "tiny", "x"), (7001, "", "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.max("copy").alias("n")).collect()}
    sizes = {"hot": 4000, "b": 1000, None: 1000, "tiny": 2}
    for key, _, source, _ in rows:
        assert got.get(key, 0) == plain_count(key, len(rows) / 4 / sizes[source])
    shares = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n / (len(rows) / 4) - 1) < 0.12 for n in shares.values())
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)


def test_target_weights_and_size(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)] + [(9000, "c")], "doc_id long, source string")
    mixed = mixing.mix(docs, {"a": 3, "b": 1}, rows=2.0, extra=False)
    assert mixed.columns == ["doc_id", "source"]
    shares = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {"a", "b"} and abs(shares["a"] / 6000 - 1) < 0.05 and abs(shares["b"] / 2000 - 1) < 0.08
    assert mixing.mix(docs, {"z": 1}).count() == 0


def test_many_sources_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 40}") for i in range(400)], "doc_id long, source string")
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(mixing.mix(docs).collect()) == whole


def test_repeated_null_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a")], "doc_id long, source string")
    counts = [r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert all(n % 2 == 0 for n in counts)
    assert mixing.mix(docs.where("false")).count() == 0
