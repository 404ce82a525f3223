"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the output over its share of the
input. A document's count inverts the Poisson distribution with that mean at a number that
its key and the seed determine; copies are exploded and shuffled globally by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabellion.llm.common import written

#: up to so many sources the rates are broadcast; beyond that they are joined by a shuffle
BROADCAST_SOURCES = 10_000
#: means are cut into parts of at most this, whose counts add up to a Poisson count of the whole
PART = 8.0
#: terms of the distribution that are added up for a part; the rest is below 2 ** -53
TERMS = 48


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the md5 of the key."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")) for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(mean: Column, chance: Column, terms: int = TERMS) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds ``chance``; 0 for a mean of 0."""
    term, total = F.exp(-mean), F.exp(-mean)
    count = F.lit(0)
    state = F.struct(term.alias("term"), total.alias("total"), count.alias("count"))
    steps = F.sequence(F.lit(1), F.lit(terms))
    return F.aggregate(
        steps,
        state,
        lambda s, k: F.struct(
            (s["term"] * mean / k).alias("term"),
            (s["total"] + s["term"] * mean / k).alias("total"),
            (s["count"] + F.when(s["total"] <= chance, 1).otherwise(0)).alias("count"),
        ),
        lambda s: s["count"],
    )


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, source: str = "source", rows: float = 1.0
) -> DataFrame:
    """(source, n, rate) per source, null a source of its own.

    ``weights`` are target shares, normalised over the sources that occur; sources that are
    not named get nothing. None weighs all sources alike. ``rows`` scales the output: its
    expected size is that times the input.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.lit(1.0)
    else:
        target = F.lit(0.0)
        for name, share in sorted(weights.items()):
            target = F.when(F.col("_source") == name, float(share)).otherwise(target)
    weighed = counts.withColumn("_target", target)
    sums = weighed.agg(F.sum("_target").alias("_targets"), F.sum("n").alias("_all"))
    # one row of two sums
    joined = weighed.crossJoin(F.broadcast(sums))
    share = F.col("_target") / F.when(F.col("_targets") > 0, F.col("_targets"))
    rate = F.coalesce(share * F.col("_all") * rows / F.col("n"), F.lit(0.0))
    return joined.select("_source", "n", rate.alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    seed: int = 1,
    rows: float = 1.0,
    extra: bool = True,
) -> DataFrame:
    """``docs`` repeated by source and in a global random order that key and seed determine.

    Adds (replacing columns of these names) ``copy``, from 1 up per document, and
    ``shuffle_key``, by which the partitions are dealt and sorted; without ``extra`` the
    columns are those of ``docs``. Rows with the same key have the same count; a null key
    counts as empty text. Null sources are a source; an empty input gives an empty result.
    """
    kept = docs.columns
    rates = repetition_rates(docs, weights, source, rows)
    rates = written(rates.select("_source", F.col("rate").alias("_rate")), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.col(doc_id).cast("string")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int")
    one = poisson(F.col("_rate"), uniform(F.lit(str(seed)), key))
    many = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), parts),
            lambda i: poisson(F.col("_rate") / parts, uniform(F.lit(str(seed)), key, i.cast("string"))),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    counted = docs.join(rates, F.col(source).eqNullSafe(F.col("_source"))).withColumn(
        "_count", F.when(F.col("_rate") <= PART, one).otherwise(many)
    )
    copies = counted.where("_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    order = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(key, F.lit("")), F.col("copy").cast("string")))
    dealt = copies.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    names = [c for c in kept if c not in ("copy", "shuffle_key")]
    return dealt.select(*names, "copy", "shuffle_key") if extra else dealt.select(*kept)
