"""Column profiles: one row per column, for any number of tables in one plan.

Columns are grouped into type families. Each family reads only its own columns, turns them
into narrow (column number, value) rows, and counts the values with a map-side combine. Row
count, nulls, distinct values, bounds, mean and samples all follow from those counts, so no
row is widened and no column needs a scan of its own.

Strings are counted by digest and first characters, so the shuffle carries a bounded number of
characters per value and never a whole text. The first characters tell which rows can hold the
smallest values and the largest; a second pass takes only those.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tabellion.functions.columns import ratio
from tabellion.functions.patterns import VALUE_PATTERNS, matches
from tabellion.session import checkpointed

SAMPLES = 5
#: first characters of a string that are counted beside its digest
PREFIX = 64
LISTING = "column int, table_name string, ordinal int, column_name string, data_type string, neighbor_columns array<string>"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
_PLAIN = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def resolve_column(df: DataFrame, name: str) -> str:
    """The actual column that equals ``name`` when case and punctuation are ignored."""
    plain = re.sub(r"[^a-zA-Z0-9]", "", name).lower()
    for column in df.columns:
        if re.sub(r"[^a-zA-Z0-9]", "", column).lower() == plain:
            return column
    return name


@dataclass(frozen=True)
class ColumnRef:
    """A profiled column and its number in the plan."""

    number: int
    table: str
    name: str
    family: str


def value_counts(tables: Mapping[str, DataFrame]) -> tuple[list[ColumnRef], dict[str, DataFrame]]:
    """The numbered columns, and per type family the frame (column, value, n) of counted values."""
    columns = _numbered(tables)
    counted = {}
    for family in sorted({c.family for c in columns}):
        rows, keys = _narrow(tables, columns, family), ["column", "value"]
        if family == "string":
            # a text no longer than its prefix needs no digest; a join would add the condition to some readers of the counts
            rows = rows.where("column is not null")
            digest = F.when(F.length("value") > PREFIX, F.sha2("value", 256)).when(F.col("value").isNotNull(), "")
            rows, keys = rows.select("column", digest.alias("value"), F.substring("value", 1, PREFIX).alias("prefix")), [*keys, "prefix"]
        counted[family] = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return columns, counted


def profile_tables(tables: Mapping[str, DataFrame], samples: int = SAMPLES, patterns_from: str = "samples") -> DataFrame:
    """Profiles of every column of every table.

    ``patterns_from='samples'`` tests the patterns on the sample values; ``'values'`` tests
    them on all distinct values, which costs a regular expression per distinct value.
    """
    spark = next(iter(tables.values())).sparkSession
    columns, counted = value_counts(tables)
    per_family = []
    for family, counts in counted.items():
        stats = _statistics(counts, family, samples, patterns_from)
        if family == "string":
            stats = _with_string_values(tables, columns, stats, counts, samples, patterns_from)
        per_family.append(stats.select(*_STATISTICS))
    found = reduce(DataFrame.unionByName, per_family)
    numbers = {(c.table, c.name): c.number for c in columns}
    listed = column_list(spark, tables, numbers)
    total = F.coalesce("total_rows", F.lit(0))
    nulls = F.coalesce("null_count", F.lit(0))
    distinct = F.coalesce("distinct_count", F.lit(0))
    zero = F.lit(0.0)
    none = F.array().cast("array<string>")
    shown = F.coalesce("sample_values", none)
    patterns = F.coalesce("detected_patterns", detected_patterns(shown))
    return listed.join(found, "column", "left").select(
        "table_name",
        "column_name",
        "ordinal",
        "data_type",
        total.alias("total_rows"),
        nulls.alias("null_count"),
        F.coalesce(ratio(nulls, total, 2, scale=100), zero).alias("null_percentage"),
        distinct.alias("distinct_count"),
        F.coalesce(ratio(distinct, total, 4), zero).alias("cardinality_ratio"),
        ((distinct == total) & (nulls == 0)).alias("is_unique"),
        "min_value",
        "max_value",
        "avg_value",
        shown.alias("sample_values"),
        patterns.alias("detected_patterns"),
        "neighbor_columns",
    )


def profile_table(df: DataFrame, name: str, **options) -> DataFrame:
    return profile_tables({name: df}, **options)


def profile_column(df: DataFrame, table: str, column: str, **options) -> DataFrame:
    """Profile of one column, scanning only that column; the other columns stay its neighbours."""
    actual = resolve_column(df, column)
    alone = profile_table(df.select(f"`{actual}`"), table, **options)
    others = F.array(*[F.lit(c) for c in df.columns if c != actual]).cast("array<string>")
    return alone.withColumns({"neighbor_columns": others, "ordinal": F.lit(df.columns.index(actual))})


def profile_sketch(df: DataFrame, name: str) -> DataFrame:
    """Counts, nulls, approximate distinct values and bounds in one scan without a shuffle of values."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (*_WHOLE, *_REAL, *_PLAIN, T.StringType))]
    rows = F.count(F.lit(1))
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            rows.alias("total_rows"),
            (rows - F.count(f"`{f.name}`")).alias("null_count"),
            F.approx_count_distinct(f"`{f.name}`").alias("approx_distinct"),
            _shown(F.min(f"`{f.name}`"), _family(f.dataType)).alias("min_value"),
            _shown(F.max(f"`{f.name}`"), _family(f.dataType)).alias("max_value"),
        ).alias(f"c{i}")
        for i, f in enumerate(fields)
    ]
    wide = df.agg(*cells)
    listed = wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(fields))])).alias("c"))
    return listed.select(F.lit(name).alias("table_name"), "c.*")


def column_list(spark: SparkSession, tables: Mapping[str, DataFrame], numbers: Mapping[tuple[str, str], int]) -> DataFrame:
    """One row per column from the schemas alone; it grows with the schema, not with the data."""
    rows = [
        (numbers[table, field.name], table, i, field.name, field.dataType.simpleString(), [c for c in df.columns if c != field.name])
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, LISTING)


def detected_patterns(samples: Column) -> Column:
    """Names of the patterns that at least half of the samples (and at least one) match."""
    enough = F.greatest(F.lit(1), F.floor(F.size(samples) / 2))
    hits = [F.when(_matching(samples, name) >= enough, F.lit(name)) for name in VALUE_PATTERNS]
    return F.array_compact(F.array(*hits))


def _matching(samples: Column, pattern: str) -> Column:
    return F.size(F.filter(samples, lambda s: matches(s, pattern)))


_STATISTICS = [
    "column",
    "total_rows",
    "null_count",
    "distinct_count",
    "avg_value",
    "min_value",
    "max_value",
    "sample_values",
    "detected_patterns",
]


def _numbered(tables: Mapping[str, DataFrame]) -> list[ColumnRef]:
    listed = [(table, field) for table, df in tables.items() for field in df.schema.fields]
    return [ColumnRef(i, table, field.name, _family(field.dataType)) for i, (table, field) in enumerate(listed)]


def _narrow(tables: Mapping[str, DataFrame], columns: list[ColumnRef], family: str) -> DataFrame:
    """(column number, value) rows of all columns of a family."""
    parts = []
    for table, df in tables.items():
        own = [c for c in columns if c.table == table and c.family == family]
        if own:
            cells = [x for c in own for x in (F.lit(c.number), _as_family(F.col(f"`{c.name}`"), family))]
            parts.append(df.select(F.stack(F.lit(len(own)), *cells).alias("column", "value")))
    return reduce(DataFrame.unionAll, parts)


def _statistics(counts: DataFrame, family: str, samples: int, patterns_from: str) -> DataFrame:
    """Counts, bounds, mean and samples per column, both from the same shuffled value counts."""
    value, n = F.col("value"), F.col("n")
    known = F.when(value.isNotNull(), n)
    aggregates = [
        F.sum(n).alias("total_rows"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count(value).alias("distinct_count"),
        _mean(value, known, family).alias("avg_value"),
    ]
    if family == "string":
        return counts.groupBy("column").agg(*aggregates)
    none = F.lit(None).cast("string")
    no_list = F.lit(None).cast("array<string>")
    if family == "nested":
        bare = counts.groupBy("column").agg(*aggregates)
        return bare.withColumns({"min_value": none, "max_value": none, "sample_values": no_list, "detected_patterns": no_list})
    aggregates += [_shown(F.min(value), family).alias("min_value"), _shown(F.max(value), family).alias("max_value")]
    if patterns_from == "values":
        aggregates.append(_patterns_of_all(value, _shown(value, family)).alias("detected_patterns"))
    stats = counts.groupBy("column").agg(*aggregates)
    if patterns_from != "values":
        stats = stats.withColumn("detected_patterns", no_list)
    return stats.join(_smallest(counts, samples, _shown(value, family)), "column", "left")


def _smallest(counts: DataFrame, samples: int, shown: Column) -> DataFrame:
    """The smallest values of each column; every task cuts to ``samples`` before the shuffle.

    Nulls sort last and are dropped at the end, and ``n`` stays in the rows, so that this
    reads the same shuffle as the statistics.
    """
    order = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())
    picked = F.when(F.col("value").isNotNull(), F.struct("_at", shown.alias("text"), "n"))
    return (
        counts.withColumn("_at", F.row_number().over(order))
        .filter(F.col("_at") <= samples)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(picked)).alias("_picked"))
        .select("column", F.col("_picked.text").alias("sample_values"))
    )


def _with_string_values(
    tables: Mapping[str, DataFrame], columns: list[ColumnRef], stats: DataFrame, counts: DataFrame, samples: int, patterns_from: str
) -> DataFrame:
    """``stats`` with the bounds and smallest values of strings.

    The ``samples`` smallest values begin with one of the ``samples`` smallest distinct
    prefixes, the largest with the largest. A prefix shorter than PREFIX is its value; only the
    columns in which one of these is as long are read again, for the rows with such a prefix.
    """
    # the counts stay in the condition, so that this reads the same shuffle as the statistics
    prefixes = counts.filter(F.when(F.col("n") > 0, F.col("prefix")).isNotNull()).select("column", "prefix").distinct()
    order = Window.partitionBy("column").orderBy("prefix")
    low = prefixes.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= samples)
    low = low.groupBy("column").agg(F.array_sort(F.collect_list("prefix")).alias("_lows"))
    high = prefixes.groupBy("column").agg(F.max("prefix").alias("_high"))
    # one row per column
    known = checkpointed(stats.join(low, "column", "left").join(high, "column", "left"))
    longest = F.greatest(F.array_max(F.transform("_lows", F.length)), F.length("_high"))
    cut = {r["column"] for r in known.where(longest >= PREFIX).select("column").collect()}
    whole = known.where(~F.col("column").isin(*cut)) if cut else known
    found = whole.where("_high is not null").select(
        "column", F.col("_high").alias("max_value"), F.col("_lows").alias("sample_values"), F.get("_lows", F.lit(0)).alias("min_value")
    )
    if cut:
        limits = known.select("column", F.element_at("_lows", -1).alias("_low"), "_high")
        found = found.unionByName(_long_values(tables, [c for c in columns if c.number in cut], limits, samples))
    if patterns_from != "values":
        return known.join(found, "column", "left").withColumn("detected_patterns", F.lit(None).cast("array<string>"))
    texts = _narrow(tables, columns, "string")
    tested = texts.filter(F.col("value").isNotNull()).select(
        "column", F.sha2("value", 256).alias("digest"), *[matches(F.col("value"), name).alias(name) for name in VALUE_PATTERNS]
    )
    enough = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2))
    hits = [F.when(F.count_if(F.col(name)) >= enough, F.lit(name)) for name in VALUE_PATTERNS]
    per_value = tested.dropDuplicates(["column", "digest"]).groupBy("column")
    patterns = per_value.agg(F.array_compact(F.array(*hits)).alias("detected_patterns"))
    return known.join(found, "column", "left").join(patterns, "column", "left")


def _long_values(tables: Mapping[str, DataFrame], columns: list[ColumnRef], limits: DataFrame, samples: int) -> DataFrame:
    """(column, max_value, sample_values, min_value) of ``columns``, from their rows with a prefix among the limits."""
    texts = _narrow(tables, columns, "string")
    # one row of two short strings per column: bounded by the schema
    near = texts.join(F.broadcast(limits), "column")
    prefix = F.substring("value", 1, PREFIX)
    top = near.filter(prefix == F.col("_high")).groupBy("column").agg(F.max("value").alias("max_value"))
    values = near.filter(prefix <= F.col("_low")).select("column", "value").distinct()
    least = _smallest(values.withColumn("n", F.lit(1)), samples, F.col("value"))
    return top.join(least, "column").select(
        "column", "max_value", "sample_values", F.get("sample_values", F.lit(0)).alias("min_value")
    )


def _patterns_of_all(value: Column, shown: Column) -> Column:
    enough = F.greatest(F.lit(1), F.floor(F.count(value) / 2))
    hits = [F.when(F.count_if(matches(shown, name)) >= enough, F.lit(name)) for name in VALUE_PATTERNS]
    return F.array_compact(F.array(*hits))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, _WHOLE):
        return "whole"
    if isinstance(kind, _REAL):
        return "real"
    if isinstance(kind, T.DecimalType):
        return "exact"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, _PLAIN):
        return "text"
    return "nested"


def _as_family(value: Column, family: str) -> Column:
    casts = {"whole": "bigint", "real": "double", "exact": "decimal(38,10)", "text": "string", "string": "string"}
    if family in casts:
        return value.cast(casts[family])
    return F.sha2(F.to_json(F.struct(value.alias("v"))), 256)


def _shown(value: Column, family: str) -> Column:
    """Text of a value; fractions lose trailing zeros and never use an exponent."""
    return shown_number(value) if family in ("real", "exact") else value.cast("string")


def shown_number(value: Column) -> Column:
    plain = value.try_cast("decimal(38,6)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), value.cast("string"))


def _mean(value: Column, known: Column, family: str) -> Column:
    """Weighted mean to two digits, in decimals; doubles beyond the decimal range use doubles."""
    if family not in ("whole", "real", "exact"):
        return F.lit(None).cast("double")
    exact = value.try_cast("decimal(28,6)")
    total = F.try_divide(F.sum(exact * known.cast("decimal(18,0)")), F.sum(known))
    rough = F.try_divide(F.sum(value.cast("double") * known), F.sum(known))
    fits = F.count(exact) == F.count(value)
    return F.when(fits, F.round(total, 2).cast("double")).otherwise(F.round(rough, 2))
