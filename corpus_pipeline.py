"""A corpus pipeline: quality, near copies, benchmark leaks, personal data, source mixture.

Each stage reads what the one before kept, written as Parquet, and returns what it keeps;
all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabellion.llm import decontamination, mixing, quality, simhash, surrogates
from tabellion.llm.common import fold, table, written
from tabellion.llm.queries import SURROGATE_KEY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.5)."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "quality", fold("doc_id", 3) != 1)
    return quality.score(docs, model, name="_score").where("_score >= 0.5").drop("_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies.

    That is the one with the smallest key (a null key last), then the smallest digest of its
    text and of its other columns; keys may be null or repeat.
    """
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    row = F.concat(F.coalesce(F.md5("text"), F.lit("")), F.md5(others)).alias("_row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("_row"))
    prints = simhash.fingerprints(docs.select("doc_id", "text", row)).select("fingerprint", order.alias("_order"))
    kept = simhash.classes(written(prints, "simhash"), "_order", max_distance=3)
    kept = kept.select(F.col("component_id._row").alias("_kept")).distinct()
    # rows with one digest are alike in all columns
    return (
        docs.withColumn("_row", row)
        .join(kept, F.col("_row") == F.col("_kept"), "left_semi")
        .dropDuplicates(["_row"])
        .drop("_row")
    )


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    replaced = surrogates.pseudonymise(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh alike, in a global random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near copies", near_copies),
    ("decontamination", benchmark_free),
    ("surrogates", private_data),
    ("mixing", source_mixture),
]

#: SQL has no classifier, SimHash, tiling or surrogates: tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
