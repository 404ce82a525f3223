import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tabellion.llm import decontamination
from tabellion.llm.common import table
from test_mixing import plain_count
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, FOLDER).cache()
        out.append((docs.collect(), kept.collect()))
        docs = kept
    return out


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.98 * len(right) and len(after) < len(before)
    assert set(after) <= set(before)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[1]
    parts = plain_components({r.doc_id: plain_fingerprint(r.text) for r in before}, 3)
    assert sorted(after) == sorted(r for r in before if parts[r.doc_id] == r.doc_id)


def test_benchmark_passages_are_gone(spark, stages):
    before, after = stages[2]
    items = [decontamination.words(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    sets = [(len(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in items]

    def leaked(text):  # a passage that is there whole shows all of its five-word runs
        words = decontamination.words(text)
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return any(len(s & runs) == len(s) for _, s in sets)

    assert sorted(after) == sorted(r for r in before if not leaked(r.text))


def test_personal_data_is_replaced(stages):
    before, after = stages[3]
    pattern = r"[\w.+-]+@[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\+1 \(\d+\) \d+-\d+|[0-9a-fA-F]{40}"
    old = {r.doc_id: r for r in before}
    assert sorted(r.doc_id for r in after) == sorted(old) and list(after[0].asDict()) == COLUMNS
    for r in after:
        source = old[r.doc_id]
        assert re.sub(pattern, "#", r.text) == re.sub(pattern, "#", source.text) and r.n_chars == len(r.text)
        assert not set(re.findall(pattern, r.text)) & set(re.findall(pattern, source.text))


def test_sources_weigh_alike(stages):
    before, after = stages[4]
    sizes: dict[str, int] = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    copies: dict[int, int] = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in before:
        assert copies.get(r.doc_id, 0) == plain_count(r.doc_id, len(before) / len(sizes) / sizes[r.source])


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*COLUMNS, "copy", "shuffle_key"]
    assert sorted(got.collect()) == sorted(stages[-1][1])


def test_stages_take_empty_and_odd_tables(spark):
    empty = table(spark, FOLDER, "documents").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, None, "en", None, 5)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
        stage(spark, odd, FOLDER).select(F.count("*")).collect()


def test_near_copies_with_null_and_repeated_keys(spark):
    docs = table(spark, FOLDER, "documents")
    story = " ".join(f"word{i}" for i in range(200))
    texts = {"a": story, "b": " ".join(f"other{i}" for i in range(200)), "c": " ".join(f"third{i}" for i in range(200))}
    rows = [
        (None, texts["a"], "en", "x", 1), (None, texts["b"], "en", "x", 1), (None, texts["b"], "en", "x", 1),  # unique, and equal rows
        (7, texts["c"], "en", "x", 1), (7, "one more text", "en", "x", 1),  # two texts of one key
        (8, texts["c"], "en", "x", 1), (None, texts["c"], "en", "x", 1),  # copies of the first of them
        (9, "one more text", "en", "y", 2), (9, "one more text", "de", "y", 2),
    ]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted((rows[i] for i in (0, 1, 3, 4)), key=str)
