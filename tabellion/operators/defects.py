"""Seeding known defects into copies of tables, and measuring which of them the rules catch.

A corrupted copy is just another plan over the clean frame. Keys are picked in key order, so
the same rows are corrupted every time; ``injected_count`` is counted, not assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import ratio
from tabellion.operators.quality import Rule, run_rules

HIT = "_hit"


@dataclass(frozen=True)
class Defect:
    """``corrupt`` maps the clean table, marked with a boolean ``_hit`` per row, to the bad copy."""

    defect_id: str
    defect_type: str
    table: str
    column: str
    key: str
    rows: int
    corrupt: Callable[[DataFrame], DataFrame]
    where: str | None = None
    added: bool = False


def mark(df: DataFrame, key: str, rows: int, where: str | None = None) -> DataFrame:
    """``df`` with ``_hit`` true where the key is among the ``rows`` smallest eligible keys."""
    eligible = df if where is None else df.filter(where)
    picked = eligible.select(F.col(key).alias("_picked")).distinct().orderBy("_picked").limit(rows)
    joined = df.join(picked, F.col(key) == F.col("_picked"), "left")
    return joined.withColumn(HIT, F.col("_picked").isNotNull()).drop("_picked")


def overwrite(column: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """Sets ``column`` to the SQL expression ``value`` in the hit rows."""

    def corrupt(marked: DataFrame) -> DataFrame:
        kind = marked.schema[column].dataType
        return marked.withColumn(column, F.when(F.col(HIT), F.expr(value).cast(kind)).otherwise(F.col(column)))

    return corrupt


def duplicate(marked: DataFrame) -> DataFrame:
    """The hit rows once more."""
    return marked.unionByName(marked.filter(HIT))


def orphan(column: str, first_key: int) -> Callable[[DataFrame], DataFrame]:
    """Copies of the hit rows whose key points nowhere."""

    def corrupt(marked: DataFrame) -> DataFrame:
        lost = marked.filter(HIT).withColumn(column, F.lit(first_key) + F.col(column))
        return marked.withColumn(HIT, F.lit(False)).unionByName(lost)

    return corrupt


def inject(tables: Mapping[str, DataFrame], defects: Sequence[Defect]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Corrupted copies of the tables, and the manifest with the number of rows each defect changed."""
    damaged = dict(tables)
    manifest: list[DataFrame] = []
    for defect in defects:
        marked = mark(damaged[defect.table], defect.key, defect.rows, defect.where)
        corrupted = defect.corrupt(marked)
        source = corrupted if defect.added else marked
        manifest.append(
            source.agg(F.count_if(HIT).alias("injected_count")).select(
                F.lit(defect.defect_id).alias("defect_id"),
                F.lit(defect.defect_type).alias("defect_type"),
                F.lit(defect.table).alias("table_name"),
                F.lit(defect.column).alias("column_name"),
                "injected_count",
            )
        )
        damaged[defect.table] = corrupted.drop(HIT)
    return damaged, reduce(DataFrame.unionAll, manifest)


def catches(manifest: DataFrame, results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each defect and whether a rule on its column failed; ``by`` names columns both sides share."""
    keys = [*by, "table_name", "column_name"]
    failed = results.groupBy(*keys).agg(F.max(~F.col("passed")).alias("_failed"))
    joined = manifest.join(failed, keys, "left")
    return joined.withColumn("caught", F.coalesce("_failed", F.lit(False))).drop("_failed")


def catch_report(found: DataFrame, clean_results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of ``catches`` with the rules that fail on clean data as false positives."""
    alarms = clean_results.groupBy(*by).agg(F.count_if(~F.col("passed")).alias("false_positives"))
    total, caught = F.count(F.lit(1)), F.count_if("caught")
    totals = found.groupBy(*by).agg(
        total.alias("total_injected_defects"),
        caught.alias("caught_defects"),
        (total - caught).alias("missed_defects"),
        ratio(caught, total, 2, scale=100).alias("catch_rate_percentage"),
    )
    if not by:
        return totals.withColumn("false_positives", alarms.scalar())
    return totals.join(alarms, list(by))


def benchmark(
    tables: Mapping[str, DataFrame], defects: Sequence[Defect], suites: Mapping[str, Sequence[Rule]]
) -> tuple[DataFrame, DataFrame]:
    """(catches per suite and defect, totals per suite) of rule suites against a set of defects.

    A rule that several suites share runs once on the clean and once on the corrupted tables.
    """
    rules = list(dict.fromkeys(rule for suite in suites.values() for rule in suite))
    spark = next(iter(tables.values())).sparkSession
    members = spark.createDataFrame(
        [(name, r.table, r.rule_type, ",".join(r.columns) if r.columns else r.column) for name, suite in suites.items() for r in suite],
        "suite string, table_name string, rule_type string, column_name string",
    )
    rule_key = ["table_name", "rule_type", "column_name"]
    damaged, manifest = inject(tables, defects)
    every = manifest.withColumn("suite", F.explode(F.array(*[F.lit(name) for name in suites])))
    found = catches(every, run_rules(damaged, rules).join(members, rule_key), ["suite"])
    clean = run_rules(tables, rules).join(members, rule_key)
    return found, catch_report(found, clean, ["suite"])
