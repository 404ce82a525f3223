"""Comparing result sets, and metrics over verdict tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tabellion.functions.columns import contains_any, first_match, ratio
from tabellion.session import checkpointed

# fixed values: rubric scores and the words of business relevance
GROUNDED, UNGROUNDED = 4.6, 4.3
RELEVANT, IRRELEVANT = 4.8, 4.2
CLEAR, UNCLEAR = 4.8, 3.8
CLEAR_LENGTH = 25
BUSINESS_WORDS = ("identifier", "currency", "amount", "timestamp", "attribute", "metric", "customer", "order", "price")

# fixed values: text length per estimated token
CHARS_PER_TOKEN = 4


def normalised(df: DataFrame) -> list[Column]:
    """The columns as comparable text: numbers to two digits, text trimmed and lower-cased, NULL spelled out."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            number = column.cast("int") if isinstance(field.dataType, T.BooleanType) else column
            text = F.coalesce(number.try_cast("decimal(38,2)").cast("string"), column.cast("string"))
        else:
            text = F.lower(F.trim(column.cast("string")))
        shown.append(F.coalesce(text, F.lit("NULL")))
    return shown


def row_text(df: DataFrame) -> Column:
    return F.to_json(F.array(*normalised(df)))


#: groups of rows whose checksums are compared first
DIFF_BUCKETS = 4096


def result_diff(left: DataFrame, right: DataFrame, buckets: int = DIFF_BUCKETS) -> DataFrame:
    """Multiset comparison of two results, by position, ignoring order.

    Normalised rows are dealt to buckets by their hash. First only the rows of a bucket are
    counted and their hashes added up, on the map side, so equal results shuffle no more than
    ``buckets`` sums a task. Rows of buckets whose sums differ are then compared as signed
    counts of whole rows. The sums hold two independent hashes of 128 bits together; a bucket
    that differs goes unseen with a probability below 1e-30. Rows of different width never
    match, so a width mismatch shows as all rows missing and extra.
    """
    sides = left.select(row_text(left).alias("row"), F.lit(1).alias("side")).unionAll(right.select(row_text(right).alias("row"), F.lit(-1).alias("side")))
    hashed = sides.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    signed = [
        F.sum(F.col("side") * F.conv(F.substring(F.md5("row"), start, 8), 16, 10).cast("bigint")).alias(f"h{start}") for start in (1, 9, 17, 25)
    ]
    sums = hashed.groupBy("bucket").agg(
        F.count_if(F.col("side") > 0).alias("l"), F.count_if(F.col("side") < 0).alias("r"), *signed
    )
    sums = checkpointed(sums)
    differs = reduce(or_, [F.col(f"h{start}") != 0 for start in (1, 9, 17, 25)]) | (F.col("l") != F.col("r"))
    total = sums.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))
    # at most ``buckets`` numbers
    other = [r[0] for r in sums.where(differs).select("bucket").collect()]
    kept = hashed.where(F.col("bucket").isin(other)) if len(other) < buckets else hashed
    if not other:
        kept = hashed.limit(0)
    per_row = kept.groupBy("row").agg(F.sum("side").alias("n"))
    missing, extra = (F.coalesce(F.sum(F.greatest(sign * F.col("n"), F.lit(0))), F.lit(0)) for sign in (1, -1))
    changes = per_row.agg(missing.alias("missing_rows"), extra.alias("extra_rows"))
    both = total.withColumn("_one", F.lit(1)).join(changes.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("equal", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0))


def confusion(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN with precision, recall and F1 (0 where undefined), per group."""
    counted = df.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(ratio(part, whole, 4), F.lit(0.0))

    return counted.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1_score": share(tp * 2, tp * 2 + fp + fn),
            "total_evaluated": tp + fp + fn + F.col("tn"),
        }
    )


def classifier_scores(gold: DataFrame, predicted: DataFrame, baseline: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Metrics of a classifier against gold labels, beside a baseline, with the F1 gained over it.

    ``gold`` holds keys, the ``by`` columns and a boolean ``is_pii``; the others keys and ``is_pii``.
    """
    both = gold.join(predicted.select(*keys, F.col("is_pii").alias("_p")), list(keys)).join(
        baseline.select(*keys, F.col("is_pii").alias("_b")), list(keys)
    )
    return with_baseline(
        confusion(both, F.col("is_pii"), F.col("_p"), by), confusion(both, F.col("is_pii"), F.col("_b"), by), by
    )


def with_baseline(own: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics with the F1 of a baseline and the difference."""
    base = baseline.select(*by, F.col("f1_score").alias("baseline_f1"))
    gain = F.round(F.col("f1_score").cast("decimal(10,4)") - F.col("baseline_f1").cast("decimal(10,4)"), 4)
    return own.join(base, list(by)).withColumn("delta_f1", gain.cast("double"))


def gate_scores(verdicts: DataFrame, refused: Column, should_refuse: Column) -> DataFrame:
    """Block rate on prompts to refuse, pass rate on the others, and overall accuracy, in percent."""
    attacks, benign = F.count_if(should_refuse), F.count_if(~should_refuse)
    blocked, passed = F.count_if(should_refuse & refused), F.count_if(~should_refuse & ~refused)
    return verdicts.agg(
        attacks.alias("total_adversarial_prompts"),
        blocked.alias("blocked_attacks"),
        (attacks - blocked).alias("leaked_attacks_count"),
        ratio(blocked, attacks, 2, scale=100).alias("governance_block_rate_pct"),
        benign.alias("total_benign_prompts"),
        passed.alias("passed_benign_requests"),
        (benign - passed).alias("false_refusal_count"),
        ratio(passed, benign, 2, scale=100).alias("benign_pass_rate_pct"),
        ratio(benign - passed, benign, 2, scale=100).alias("false_refusal_rate_pct"),
        ratio(blocked + passed, attacks + benign, 2, scale=100).alias("overall_governance_accuracy_pct"),
    )


def answer_matches(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Per condition and question, whether the answer rows equal the gold rows as a multiset.

    ``answers``: condition, question, row; ``gold``: question, row (normalised text). Rows are
    counted before the join, so repeated rows cost nothing. An answer is equal if each of its
    row counts is the gold count and it has as many rows as the gold answer.
    """
    wanted = gold.groupBy("question", "row").agg(F.count(F.lit(1)).alias("_g"))
    sizes = wanted.groupBy("question").agg(F.sum("_g").alias("_size"))
    given = answers.groupBy("condition", "question", "row").agg(F.count(F.lit(1)).alias("_a"))
    compared = given.join(wanted, ["question", "row"], "left").groupBy("condition", "question").agg(
        F.bool_and(F.col("_a").eqNullSafe(F.col("_g"))).alias("_same"), F.sum("_a").alias("_rows")
    )
    matched = F.col("_same") & (F.col("_rows") == F.col("_size"))
    return compared.join(sizes, "question").select("condition", "question", matched.alias("matched"))


def answer_accuracy(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """Matched questions per condition and the accuracy in percent; unanswered questions count as wrong."""
    asked = gold.agg(F.countDistinct("question").alias("n")).scalar()
    counted = matches.groupBy("condition").agg(F.count_if("matched").alias("matches"))
    return counted.withColumn("total_questions", asked).withColumn(
        "accuracy_pct", ratio(F.col("matches"), F.col("total_questions"), 2, scale=100)
    )


def ablation(accuracies: DataFrame, full: str) -> DataFrame:
    """Each configuration's accuracy and its difference from the full configuration."""
    best = accuracies.filter(F.col("condition") == full).select("accuracy_pct").scalar()
    drop = F.col("accuracy_pct").cast("decimal(8,2)") - best.cast("decimal(8,2)")
    return accuracies.withColumn("drop_points", drop.cast("double"))


#: names of data types that are no ordinary words
TYPE_NAMES = ("int", "bigint", "double", "float", "decimal", "varchar", "boolean", "timestamp_ntz", "array")


def rubric(df: DataFrame, text: str = "description") -> DataFrame:
    """Grounding, relevance and clarity of each description, from fixed rules.

    A description is hallucinated if it names a data type that is not the column's.
    """
    lowered = F.lower(text)
    named = F.array_intersect(F.split(lowered, "[^a-z0-9_]+"), F.array(*[F.lit(t) for t in TYPE_NAMES]))
    invented = F.size(F.filter(named, lambda t: t != F.lower("data_type"))) > 0
    grounded = lowered.contains(F.lower("data_type")) | F.lower("column_name").contains("id")
    scores = {
        "grounding": F.when(grounded, GROUNDED).otherwise(UNGROUNDED),
        "relevance": F.when(contains_any(lowered, BUSINESS_WORDS), RELEVANT).otherwise(IRRELEVANT),
        "clarity": F.when(F.length(text) > CLEAR_LENGTH, CLEAR).otherwise(UNCLEAR),
    }
    total = sum((s.cast("decimal(4,2)") for s in scores.values()), F.lit(0).cast("decimal(4,2)"))
    overall = F.round(total / F.lit(3).cast("decimal(2,0)"), 2).cast("double")
    return df.withColumns({**scores, "overall": overall, "hallucinated": F.coalesce(invented, F.lit(False))})


def rubric_summary(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))

    def mean(name: str) -> Column:
        return F.round(F.sum(F.col(name).cast("decimal(10,2)")) / n, 2).cast("double")

    return scored.agg(
        n.alias("samples_evaluated"),
        mean("overall").alias("mean_rubric_score_out_of_5"),
        mean("grounding").alias("technical_grounding"),
        mean("relevance").alias("domain_relevance"),
        mean("clarity").alias("clarity"),
        F.count_if("hallucinated").alias("hallucinations_detected_count"),
        ratio(F.count_if("hallucinated"), n, 3).alias("hallucination_rate"),
    )


def estimated_tokens(text: str) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def priced(calls: DataFrame, prices: Mapping[str, tuple[str, str]], default: str) -> DataFrame:
    """Cost of each call: tokens times the model's price per million (input, output).

    Prices are a constant of the query, so they become a CASE; unknown models pay the default.
    """

    def rate(position: int) -> Column:
        branches = [(F.col("model") == m, _decimal(p[position])) for m, p in prices.items()]
        return first_match(branches, _decimal(prices[default][position]))

    per_million = F.col("input_tokens") * rate(0) + F.col("output_tokens") * rate(1)
    return calls.withColumn("cost_usd", F.round(per_million / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast("double"))


def usage(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, tokens, cost and mean latency, per group."""
    exact = F.sum(F.col("cost_usd").cast("decimal(18,6)"))
    n = F.count(F.lit(1))
    return calls.groupBy(*by).agg(
        n.alias("total_entries"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(exact, 6).cast("double").alias("total_cost_usd"),
        F.round(exact * 1000 / n, 4).cast("double").alias("cost_per_1k_calls"),
        F.round(F.sum(F.col("latency_ms").cast("decimal(18,2)")) / n, 2).cast("double").alias("avg_latency_ms"),
    )


def extract_json(text: Column) -> Column:
    """The JSON object inside a text: a fenced block if there is one, then first brace to last."""
    whole = F.btrim(text)
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(whole)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def metrics_table(metrics: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(metric, value) rows from one-row frames: metric name -> (frame, column)."""
    rows = [df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value")) for name, (df, column) in metrics.items()]
    return reduce(DataFrame.unionAll, rows)


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(12,6)")
