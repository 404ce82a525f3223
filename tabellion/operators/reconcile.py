"""Reconciling the annotations of a column, and accounting for a whole enrichment run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.columns import present
from tabellion.functions.patterns import stripped

# fixed values: gates and marks of the reconciliation
REDACTED = "[REDACTED_PII]"
MIN_LEAK_LENGTH = 3
MIN_CONFIDENCE = 0.80
CONTACT_PATTERNS = ("EMAIL_PATTERN", "PHONE_PATTERN", "ZIP_PATTERN")

# fixed values: token estimate and price per 1000 tokens
CHARS_PER_TOKEN = 4
INPUT_BASE, OUTPUT_BASE = 120, 80
INPUT_PRICE, OUTPUT_PRICE = 0.00015, 0.00060


def leaked_values(samples: Column, text: Column, shortest: int) -> Column:
    """Trimmed samples of at least ``shortest`` characters that occur in the text, ignoring case."""
    trimmed = F.transform(samples, stripped)
    return F.filter(trimmed, lambda s: (F.length(s) >= shortest) & F.lower(text).contains(F.lower(s)))


def redact_values(text: Column, values: Column, mark: str = REDACTED) -> Column:
    """``text`` with every listed value replaced whatever its case.

    All values are searched at once, the longest first: a value that is part of another leaves
    nothing of the longer one, and none is looked for inside a mark. Null and empty values hide
    nothing.
    """
    known = F.filter(values, lambda v: v.isNotNull() & (F.length(v) > 0))
    longest = F.array_sort(known, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    either = F.concat(F.lit("(?iu)(?:"), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(known) > 0, F.regexp_replace(text, either, F.lit(mark))).otherwise(text)


# fixed values: the fields that make up the context of a column, in order
CONTEXT_FIELDS = (
    "table_name",
    "column_name",
    "data_type",
    "total_rows",
    "null_count",
    "null_percentage",
    "distinct_count",
    "cardinality_ratio",
    "is_unique",
    "min_value",
    "max_value",
    "avg_value",
    "sample_values",
    "detected_patterns",
    "neighbor_columns",
)


def reconcile(annotated: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One reconciled row per column, from the output of ``classify.annotate``.

    ``keep`` names further columns of the input to carry along.
    """
    clf, desc = F.col("classification"), F.col("description")
    gloss, patterns = F.col("glossary"), F.col("detected_patterns")
    none = F.array().cast("array<string>")
    leaks = F.when(clf["is_pii"], leaked_values(F.col("sample_values"), desc["description"], MIN_LEAK_LENGTH)).otherwise(none)
    contact = F.arrays_overlap(patterns, F.array(*[F.lit(p) for p in CONTACT_PATTERNS]))
    disagree = ~clf["is_pii"] & contact
    scores = [desc["confidence"], clf["confidence"], gloss["confidence"], F.col("rules_confidence")]
    lowest = F.least(*scores)
    doubtful = lowest < MIN_CONFIDENCE
    overall = sum((s.cast("decimal(5,3)") for s in scores), F.lit(0).cast("decimal(5,3)")) / F.lit(4).cast("decimal(2,0)")

    leak_flags = F.transform(
        "_leaks",
        lambda s: _flag("PII_SAMPLE_LEAKAGE", "CRITICAL", F.concat(F.lit("Description shows the sample value '"), s, F.lit("'.")), "redacted and queued"),
    )
    other_flags = present(
        F.when(
            F.col("_disagree"),
            _flag(
                "PATTERN_DISAGREEMENT",
                "WARNING",
                F.concat(F.lit("Values match "), F.array_join(patterns, ", "), F.lit(" but the column was not classified as PII.")),
                "marked as PII and queued",
            ),
        ),
        F.when(
            F.col("_doubtful"),
            _flag("LOW_CONFIDENCE", "WARNING", F.concat(F.lit("Lowest confidence "), lowest.cast("string"), F.lit(".")), "queued"),
        ),
    )
    return annotated.withColumns({"_leaks": leaks, "_disagree": disagree, "_doubtful": doubtful}).select(
        "table_name",
        "column_name",
        redact_values(desc["description"], F.col("_leaks")).alias("description"),
        (clf["is_pii"] | F.col("_disagree")).alias("is_pii"),
        F.when(
            F.col("_disagree"), F.when(F.array_contains(patterns, "ZIP_PATTERN"), "POSTAL_CODE").otherwise("SENSITIVE")
        )
        .otherwise(clf["pii_type"])
        .alias("pii_type"),
        clf["sensitivity_level"].alias("sensitivity_level"),
        gloss["term_name"].alias("glossary_term"),
        F.size("rules").cast("bigint").alias("suggested_rules_count"),
        F.round(overall, 3).cast("double").alias("overall_confidence"),
        ((F.size("_leaks") == 0) & ~F.col("_disagree") & ~F.col("_doubtful")).alias("can_auto_write"),
        F.concat(leak_flags, other_flags).alias("flags"),
        F.concat(
            _labelled("Describer", F.slice(desc["evidence"], 1, 2)),
            _labelled("Classifier", F.slice(clf["evidence"], 1, 2)),
            _labelled("Glossary", F.slice(gloss["evidence"], 1, 1)),
            _labelled("Quality", F.slice(F.transform("rules", lambda r: r["rationale"]), 1, 1)),
        ).alias("reconciled_evidence"),
        *keep,
    )


def account(annotated: DataFrame) -> DataFrame:
    """Estimated tokens and cost per column, from the size of its context and of its result."""
    context = F.concat(_json(CONTEXT_FIELDS), F.lit(" | Lineage: None"))
    asked = annotated.withColumn("input_tokens", _tokens(context, INPUT_BASE))
    told = reconcile(asked, keep=["input_tokens"])
    result = _json([c for c in told.columns if c != "input_tokens"])
    cost = F.col("input_tokens") * _price(INPUT_PRICE) + F.col("output_tokens") * _price(OUTPUT_PRICE)
    return told.withColumn("output_tokens", _tokens(result, OUTPUT_BASE)).select(
        "table_name",
        "column_name",
        "input_tokens",
        "output_tokens",
        F.round(cost, 6).cast("double").alias("cost_usd"),
        "can_auto_write",
        F.size("flags").cast("bigint").alias("flag_count"),
    )


def summarise(accounts: DataFrame) -> DataFrame:
    """The estate-wide totals of an enrichment run."""
    auto = F.count_if("can_auto_write")
    return accounts.agg(
        F.count(F.lit(1)).alias("total_columns_enriched"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")), 4).cast("double").alias("total_cost_usd"),
        auto.alias("auto_approved_count"),
        (F.count(F.lit(1)) - auto).alias("queued_for_review_count"),
        F.sum("flag_count").alias("reconciliation_flags_count"),
    )


def _price(per_thousand: float) -> Column:
    return F.lit(f"{per_thousand / 1000:.8f}").cast("decimal(12,8)")


def _tokens(text: Column, base: int) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN) + base


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _labelled(who: str, evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.concat(F.lit(f"[{who}] "), e))


def _flag(kind: str, severity: str, text: Column, action: str) -> Column:
    return F.struct(
        F.lit(kind).alias("flag_type"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
        F.lit(action).alias("action_taken"),
    )
