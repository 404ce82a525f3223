"""Data-quality rules: running them, scoring tables, gating certification.

All row-wise rules of a table become one aggregate over one scan. Uniqueness and reference rules
of all tables share one shuffle: a scan of a table emits a digest per rule that the table has a
part in, as child or as parent, and digests are counted by rule, a frequent key being combined
on the map side. Totals reduce their own columns by key before they are joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType

from tabellion.functions.columns import ratio
from tabellion.functions.patterns import VALUE_PATTERNS, stripped

# fixed values: rule weights and the certification gate
WEIGHTS = {"ERROR": 2, "WARNING": 1}
CERTIFY_SCORE = 0.85

RESULT_COLUMNS = [
    "table_name",
    "rule_type",
    "column_name",
    "severity",
    "passed",
    "failing_rows_count",
    "total_rows_count",
]


@dataclass(frozen=True)
class Rule:
    """One check of one table.

    ``NOT_NULL``, ``UNIQUE`` (also over ``columns``), ``RANGE_CHECK`` (``low``/``high``),
    ``PATTERN_MATCH`` (``pattern``: a named pattern or a regular expression),
    ``TEMPORAL_ORDER`` (``column`` must not precede ``other``),
    ``REFERENTIAL_INTEGRITY`` (``column`` must occur in ``ref_table.ref_column``),
    ``RECONCILE_TOTAL`` (``column`` must equal the sum of ``detail`` over ``ref_table`` rows
    with the same ``key``, within ``tolerance``).
    """

    table: str
    rule_type: str
    column: str
    severity: str = "ERROR"
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    other: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    key: str | None = None
    detail: str | None = None
    tolerance: float = 0.0


ROW_RULES = ("NOT_NULL", "RANGE_CHECK", "PATTERN_MATCH", "TEMPORAL_ORDER")
KEY_RULES = ("UNIQUE", "REFERENTIAL_INTEGRITY")


def run_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: how many rows fail it, of how many."""
    by_table: dict[str, list[Rule]] = {}
    for rule in rules:
        by_table.setdefault(rule.table, []).append(rule)
    parts: list[DataFrame] = []
    for table, own in by_table.items():
        df = tables[table]
        simple = [r for r in own if r.rule_type in ROW_RULES]
        if simple:
            parts.append(_row_rules(df, simple))
        for rule in own:
            if rule.rule_type == "RECONCILE_TOTAL":
                parts.append(_total(df, tables[rule.ref_table], rule))
            elif rule.rule_type not in ROW_RULES + KEY_RULES:
                raise ValueError(f"unknown rule type {rule.rule_type!r}")
    keyed = [r for r in rules if r.rule_type in KEY_RULES]
    if keyed:
        parts.append(_key_rules(tables, keyed))
    return reduce(DataFrame.unionByName, parts)


def proposals_to_rules(proposals: DataFrame) -> list[Rule]:
    """Runnable rules from proposal rows; their number is bounded by the width of the schemas."""
    rows = proposals.select("table_name", "column_name", "rule_type", "severity", "min_value", "max_value", "pattern_name").collect()
    return [
        Rule(r.table_name, r.rule_type, r.column_name, r.severity, low=r.min_value, high=r.max_value, pattern=r.pattern_name)
        for r in rows
    ]


def failing(rule: Rule) -> Column:
    """Condition under which a row fails a row-wise rule; null values pass all but NOT_NULL."""
    column = F.col(f"`{rule.column}`")
    if rule.rule_type == "NOT_NULL":
        return column.isNull()
    if rule.rule_type == "RANGE_CHECK":
        below = F.lit(False) if rule.low is None else column < rule.low
        above = F.lit(False) if rule.high is None else column > rule.high
        return column.isNotNull() & (below | above)
    if rule.rule_type == "TEMPORAL_ORDER":
        return F.coalesce(column < F.col(f"`{rule.other}`"), F.lit(False))
    text = stripped(column.cast("string"))
    expression = VALUE_PATTERNS.get(rule.pattern, rule.pattern)
    return column.isNotNull() & ~text.rlike(expression)


def score_tables(results: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Weighted score per table; ``tables`` (table_name) adds the tables that have no rules."""
    weight = F.when(F.col("severity") == "ERROR", WEIGHTS["ERROR"]).otherwise(WEIGHTS["WARNING"])
    passed = F.col("passed")
    scored = results.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(passed).alias("passed_rules"),
        F.count_if(~passed).alias("failed_rules"),
        ratio(F.sum(F.when(passed, weight).otherwise(0)), F.sum(weight), 3).alias("quality_score"),
        F.count_if(~passed & (F.col("severity") == "ERROR")).alias("error_failures"),
    )
    if tables is not None:
        scored = tables.select("table_name").join(scored, "table_name", "left").na.fill(
            {"total_rules": 0, "passed_rules": 0, "failed_rules": 0, "quality_score": 1.0, "error_failures": 0}
        )
    gate = (F.col("quality_score") >= CERTIFY_SCORE) & (F.col("error_failures") == 0)
    return scored.withColumn("can_certify", gate)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table and whether it has any."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counted).withColumn("has_rows", F.col("row_count") > 0)


def _row_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    counts = [F.count_if(failing(rule)).alias(f"r{i}") for i, rule in enumerate(rules)]
    one = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    cells = [_cell(rule, F.col(f"r{i}"), F.col("total")) for i, rule in enumerate(rules)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*").select(*RESULT_COLUMNS)


def _key_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Uniqueness and references of all tables: one scan per table, one shuffle of (rule, key digest) for all.

    Null keys are counted but neither repeat nor point anywhere.
    """
    emitted: dict[str, list[Column]] = {}
    for number, rule in enumerate(rules):
        names = rule.columns or (rule.column,)
        kinds = [None] * len(names)
        if rule.rule_type == "REFERENTIAL_INTEGRITY":
            own, other = tables[rule.table].schema[rule.column].dataType, tables[rule.ref_table].schema[rule.ref_column].dataType
            kinds = [None if own == other else _common(tables[rule.table], rule.column, tables[rule.ref_table], rule.ref_column)]
            emitted.setdefault(rule.ref_table, []).append(_entry(number, _digest(tables[rule.ref_table], (rule.ref_column,), kinds), parent=True))
        emitted.setdefault(rule.table, []).append(_entry(number, _digest(tables[rule.table], names, kinds), parent=False))
    scans = [tables[name].select(F.explode(F.array(*entries)).alias("e")).select("e.*") for name, entries in emitted.items()]
    keys = reduce(DataFrame.unionAll, scans).groupBy("rule", "key").agg(F.sum("child").alias("n"), F.max("parent").alias("parent"))
    unique = [i for i, rule in enumerate(rules) if rule.rule_type == "UNIQUE"]
    wrong = F.when(F.col("key").isNull(), 0).when(F.col("rule").isin(unique), F.col("n") - 1).when(F.col("parent") == 0, F.col("n")).otherwise(0)
    totals = keys.groupBy("rule").agg(F.sum(wrong).alias("bad"), F.sum("n").alias("total"))
    shown = [(i, r.table, r.rule_type, ",".join(r.columns) if r.columns else r.column, r.severity) for i, r in enumerate(rules)]
    # a row per rule: the list of rules is a parameter
    listed = keys.sparkSession.createDataFrame(shown, "rule int, table_name string, rule_type string, column_name string, severity string")
    bad, total = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("bad", "total"))  # an empty table has no groups
    return listed.join(totals, "rule", "left").select(
        "table_name", "rule_type", "column_name", "severity", (bad == 0).alias("passed"),
        bad.alias("failing_rows_count"), total.alias("total_rows_count"),
    )


def _common(left: DataFrame, a: str, right: DataFrame, b: str) -> DataType:
    """The type in which the engine compares two columns."""
    either = left.select(F.col(f"`{a}`").alias("k")).limit(0).unionAll(right.select(F.col(f"`{b}`")).limit(0))
    return either.schema["k"].dataType


def _digest(df: DataFrame, names: Sequence[str], kinds: Sequence[DataType | None]) -> Column:
    """128 bits of the values as text, null if one of them is null; equal values have equal texts."""
    texts = []
    for name, kind in zip(names, kinds, strict=True):
        column, kind = F.col(f"`{name}`"), kind or df.schema[name].dataType
        if isinstance(kind, DoubleType | FloatType):
            column = column.cast(kind) + F.lit(0.0).cast(kind)  # -0.0 becomes 0.0
        text = F.hex(column) if isinstance(kind, BinaryType) else column.cast(kind).cast("string")
        texts.append(text)
    if len(texts) > 1:  # lengths keep ('a', 'bc') and ('ab', 'c') apart
        texts = [part for text in texts for part in (F.length(text).cast("string"), F.lit(":"), text)]
    return F.unhex(F.md5(F.concat(*texts)))


def _entry(number: int, key: Column, parent: bool) -> Column:
    child, known = (0, 1) if parent else (1, 0)
    return F.struct(
        F.lit(number).alias("rule"), key.alias("key"), F.lit(child).cast("bigint").alias("child"), F.lit(known).alias("parent")
    )


def _total(df: DataFrame, detail: DataFrame, rule: Rule) -> DataFrame:
    exact = "decimal(18,4)"
    sums = detail.groupBy(F.col(rule.key).alias("_key")).agg(F.sum(F.expr(rule.detail).cast(exact)).alias("_sum"))
    stated = F.col(f"`{rule.column}`").cast(exact)
    gap = F.abs(stated - F.coalesce("_sum", F.lit(0).cast(exact)))
    totals = df.join(sums, df[rule.key] == F.col("_key"), "left").agg(
        F.count_if(gap > F.lit(rule.tolerance).cast(exact)).alias("bad"), F.count(F.lit(1)).alias("total")
    )
    return _result(totals, rule)


def _result(totals: DataFrame, rule: Rule) -> DataFrame:
    return totals.select(_cell(rule, F.col("bad"), F.col("total")).alias("r")).select("r.*").select(*RESULT_COLUMNS)


def _cell(rule: Rule, bad: Column, total: Column) -> Column:
    return F.struct(
        F.lit(rule.table).alias("table_name"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(",".join(rule.columns) if rule.columns else rule.column).alias("column_name"),
        F.lit(rule.severity).alias("severity"),
        (bad == 0).alias("passed"),
        bad.alias("failing_rows_count"),
        total.alias("total_rows_count"),
    )
