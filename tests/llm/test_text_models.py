import numpy as np
import pytest
from pyspark.sql import functions as F

from tabellion.llm import langid, quality, token_counts, toxicity
from tabellion.llm.common import fold, labelled_sample, table
from tabellion.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SMALL).where("held_out").select("doc_id", "predicted", "score")
    labels = table(spark, SMALL, "labels").select("doc_id", F.col(label).alias("truth"))
    return rows.join(labels, "doc_id").toPandas()


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, "op6_quality", "quality")
    assert (rows.predicted == rows.truth).mean() >= 0.97
    assert rows.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, "op4_toxicity", "toxic")
    assert (rows.predicted == rows.truth).mean() >= 0.93
    assert (rows[rows.truth == 0].predicted == 0).mean() >= 0.96


def test_language_on_held_out_rows(spark):
    truth = table(spark, SMALL, "documents").select("doc_id", "lang")
    rows = QUERIES["op5_language"](spark, SMALL).where("held_out").join(truth, "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() >= 0.98


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !? \n", "c"), (4, "good text here. " * 20_000, "d"), (None, "some words", "e"), (1, None, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_odd_texts_get_scores(spark, odd_docs):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "text", "here", "words"], 12)) for _ in range(40)]
    labels = np.array([0, 1] * 20)
    texts = [t + (" you idiot fool" if y else "") for t, y in zip(texts, labels, strict=True)]
    model = quality.fit([quality.ngrams(t) for t in texts], labels)
    scored = quality.score(odd_docs, model)
    assert sorted(scored.columns) == ["doc_id", "score", "text"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    machine = toxicity.fit(texts, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd_docs, machine).collect())
    scores = machine.scores(["good text idiot fool", "good text here words", "good i.d.i.o.t f-o-o-l words", "text idxiot foool words"], {})
    assert scores[0] > 0.5 > scores[1]
    assert scores[2] > 0.5 and scores[3] > scores[1]


def test_one_class_and_no_rows(spark, odd_docs):
    for labels in ([], [1, 1], [0, 0]):
        texts = ["a b c"] * len(labels)
        for model, value in (
            (quality.fit([quality.ngrams(t) for t in texts], np.array(labels, int)), labels[0] if labels else 1),
            (toxicity.fit(texts, np.array(labels, int)), labels[0] if labels else 0),
        ):
            got = model.score(quality.ngrams("x")) if isinstance(model, quality.Model) else model.scores(["x"], {})[0]
            assert round(float(got)) == value


def test_labels_with_nulls_repeats_and_ties(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (4, 0), (None, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.text, r.label) for r in rows) == [("a", 1), ("d", 0)]
    hot = docs.union(spark.range(500).selectExpr("1L AS doc_id", "concat('text ', id) AS text"))
    assert labelled_sample(hot, labels, "quality", F.lit(True), 10).count() == 2
    empty = labels.where("doc_id > 99")
    assert quality.train(docs, empty, "quality", F.lit(True)).score(quality.ngrams("x")) > 0.5


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [("the cat and the dog are in the house with this", "en"), ("el perro y la casa en los montes para las", "es"), ("и это дом на улице", "ru"), (None, "en"), ("x", None)],
        "text string, lang string",
    )
    model = langid.train(docs, F.lit(True))
    assert model.langs == ["en", "es", "ru"]
    rows = spark.createDataFrame(
        [(1, "the cat and the dog are in the house " * 3 + "el perro y la casa en los montes " * 2, "z"), (2, None, "z"), (3, "12 !", "z"), (4, "", "z"), (5, "дом", "z"), (6, "the house " * 30_000, "z"), (7, "½ ² Ⅷ ① 12 ৩", "z")],
        "doc_id long, text string, lang_pred string",
    )
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "es"] and got[1].lang_pred == "en" and 0.5 < got[1].score < 1
    assert got[1].spans[1].end == len(rows.first().text.rstrip())
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (2, 3, 4, 7)] == [("und", 0.0, [])] * 4
    assert got[5].lang_pred == "ru" and got[6].lang_pred == "en"
    nothing = langid.train(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(rows, nothing).collect()} == {"und"}


def plain_viterbi(scores, penalty):
    total, back = scores[0].copy(), []
    for row in scores[1:]:
        options = total[:, None] - penalty * (1 - np.eye(len(total)))
        back.append(options.argmax(axis=0))
        total = options.max(axis=0) + row
    return total.max()


def test_path_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.normal(size=(rng.integers(1, 12), 3)) * rng.choice([0.5, 3, 10])
        model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((langid.SCRIPTS, 3), bool), 5.0)
        path = model.path(scores)
        path = np.full(len(scores), path) if isinstance(path, int) else path
        value = scores[np.arange(len(scores)), path].sum() - 5.0 * (np.diff(path) != 0).sum()
        assert np.isclose(value, plain_viterbi(scores, 5.0))


def test_token_counts_match_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models

    scores = token_counts.unigram_scores()
    pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -1000.0) for i in range(256)], *scores.items()]
    plain = Tokenizer(models.Unigram(pieces, 0, True))
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(901, None), (902, ""), (903, "日本 語 🙂\n\n  x"), (904, "y" * 300 + " z"), (903, "a b")], "doc_id long, text string")
    rows = token_counts.count_tokens(docs.unionByName(extra).withColumn("n_tokens", F.lit("mine")), scores).collect()
    for row in rows:
        words = token_counts.pre_tokens(row.text or "")
        assert "".join(words) == (row.text or "")
        assert row.n_tokens == sum(len(plain.encode(w.replace(" ", "▁")).tokens) for w in words)
    assert token_counts.count_tokens(docs.limit(0), scores).count() == 0


def test_token_trie_starts_anew(monkeypatch):
    scores = token_counts.unigram_scores()
    texts = ["the cat sat on the mat", "another text with other words", "the cat again"]
    whole = token_counts.Trie(scores)
    monkeypatch.setattr(token_counts, "MOST_NODES", 3)
    small = token_counts.Trie(scores)
    assert [whole.text_tokens(t) for t in texts] == [small.text_tokens(t) for t in texts]


def test_fold(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [0, 7, 123456, None]], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 if r.doc_id is not None else None for r in rows]


def test_subsequence_kernel_by_enumeration():
    from itertools import combinations

    def features(word):
        text, out = "\x02" + word + "\x03", {}
        for places in combinations(range(len(text)), toxicity.ORDER):
            skipped = places[-1] - places[0] - toxicity.ORDER + 1
            if skipped <= toxicity.SKIPS:
                key = tuple(text[i] for i in places)
                out[key] = out.get(key, 0) + toxicity.DECAY**skipped
        return out

    words = ["idiot", "idxiot", "i", "banana", "nothing"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(map(features, words)):
        for j, b in enumerate(map(features, words)):
            dot = sum(v * b.get(k, 0) for k, v in a.items())
            norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert np.isclose(got[i, j], dot / norm)
