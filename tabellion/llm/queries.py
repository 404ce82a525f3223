"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabellion.llm import (
    decontamination,
    embeddings,
    hard_negatives,
    html_template,
    langid,
    mixing,
    phrases,
    quality,
    simhash,
    surrogates,
    syncmers,
    token_counts,
    toxicity,
)
from tabellion.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: production key of the surrogates; a deployment passes its own
SURROGATE_KEY = "tabellion surrogates 1"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _scored(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """The digest of a classifier: fold and prediction beside the score."""
    return docs.select(
        "doc_id",
        F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """(document, benchmark item) pairs where tiles of five words cover 0.8 of the item."""
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.95 or more."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = html_template.extract(table(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; learned outside of fold 0 of 5."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), "toxic", fold("doc_id", 5) != 0)
    return _scored(toxicity.score(docs, model), 5, 0)


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; learned outside of fold 2 of 4."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", held, "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")
    )


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; learned outside of fold 1 of 3."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), "quality", fold("doc_id", 3) != 1)
    return _scored(quality.score(docs, model), 3, 1)


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the unigram reading of a public vocabulary."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.unigram_scores())
    return counted.select("doc_id", "n_tokens")


@query
def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of replaced mentions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, SURROGATE_KEY, keep_count="n_replaced")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents repeated so that all sources weigh alike, in a global random order."""
    return mixing.mix(table(spark, folder, "documents"))


# means above the operator's part size are split there; the oracle splits them alike
ORACLES["op9_mixing"] = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM counts)) * (SELECT count(*) FROM documents) / n AS rate
    FROM counts),
parts AS (
    SELECT d.*, r.rate, greatest(1, ceil(r.rate / 8.0))::INT AS parts
    FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (
    SELECT p.*, p.rate / p.parts AS mean, i.i,
        ('0x' || substr(md5('1|' || coalesce(p.doc_id::VARCHAR, '')
            || CASE WHEN p.rate <= 8.0 THEN '' ELSE '|' || i.i::VARCHAR END), 1, 13))::BIGINT
            / 4503599627370496.0::DOUBLE AS chance
    FROM parts p, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS i) i),
terms AS (
    SELECT d.*, k, sum(exp(-d.mean + j * ln(d.mean) - lgamma(j + 1))) AS total
    FROM draws d, LATERAL (SELECT unnest(range(0, 48)) AS k) s, LATERAL (SELECT unnest(range(0, k + 1)) AS j) t
    GROUP BY ALL),
counted AS (
    SELECT doc_id, text, lang, source, n_chars, count(*) FILTER (total <= chance) AS copies
    FROM terms GROUP BY doc_id, text, lang, source, n_chars)
SELECT doc_id, text, lang, source, n_chars, c::INT AS copy,
    md5('order 1|' || coalesce(doc_id::VARCHAR, '') || '|' || c::VARCHAR) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, copies + 1)) AS c) e
"""


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose SimHash differs in at most three bits."""
    return simhash.near_duplicates(table(spark, folder, "documents")).withColumn(
        "fingerprint", simhash.hex_digits(F.col("fingerprint"))
    )


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the positives of every hundredth vector."""
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
    SELECT vec_id, label, floor(unnest(embedding)::DOUBLE * 256)::BIGINT AS x, unnest(range(1, len(embedding) + 1)) AS i
    FROM usable),
scores AS (
    SELECT a.vec_id AS anchor, a.label AS own, r.vec_id AS other, r.label AS label, sum(a.x * r.x)::BIGINT AS score
    FROM parts a JOIN parts r ON a.i = r.i
    WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
    SELECT anchor, other AS positive, score FROM scores WHERE label = own AND other <> anchor
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
ranked AS (
    SELECT p.anchor, p.positive, p.score AS top, s.other, s.score,
        row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other) AS rank
    FROM positives p JOIN scores s ON s.anchor = p.anchor
    WHERE s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, other AS negative_id, top AS positive_score,
    score AS negative_score
FROM ranked WHERE rank <= 5
"""


@query
def op12_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Syncmer fingerprints of every document and of its edited text, and their likeness."""
    made = syncmers.compare_edited(table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.digest(F.col("anchors")).alias("fingerprint"),
        syncmers.digest(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op13_collocations"] = r"""
WITH lowered AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
runs AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts),
f AS (
    SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
    FROM runs GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
candidates AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
lengths AS (SELECT lang, w, a, words, unnest(range(2, words)) AS k FROM candidates WHERE words > 2),
places AS (SELECT lang, w, a, k, unnest(range(1, words - k + 2)) AS i FROM lengths),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM places GROUP BY ALL),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
    WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * c.a::HUGEINT),
cuts AS (SELECT lang, phrase, a, w, words, unnest(range(1, words)) AS k FROM kept),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, ((2000000::HUGEINT * c.a) // (l.n + r.n))::BIGINT AS score
    FROM cuts c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
