"""Mergeable column profiles: one row of sketches per column and partition.

A partition is read once, in one scan that shuffles one row per column and task. Its row holds
counts, bounds and exact sums, a HyperLogLog sketch of the distinct values and, for numbers, a
KLL sketch of the quantiles. Rows of several partitions merge into the row of their union, so
that a table that grows by partitions is profiled by reading the new ones only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tabellion.functions.columns import ratio
from tabellion.functions.patterns import VALUE_PATTERNS, matches
from tabellion.operators.profile import shown_number

#: HyperLogLog precision (relative standard error 1.04 / sqrt(2 ** LG_K)) and KLL size (rank error about 2.3 / K ** 0.9021)
LG_K, KLL_K = 12, 400
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.02
QUANTILES = (0.25, 0.5, 0.75)
KEYS = ("table_name", "column_name")
EXACT = "decimal(38,6)"

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TEXTS = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def sketched(df: DataFrame) -> list[T.StructField]:
    """The columns that have sketches: numbers, text, dates and booleans."""
    return [f for f in df.schema.fields if isinstance(f.dataType, _NUMBERS + _TEXTS)]


def sketch(df: DataFrame, table: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per column and value of the ``by`` columns: counts, bounds, sum and sketches, in one scan.

    Values of floating columns that are not finite count, but have no part in sums and quantiles.
    """
    fields = [f for f in sketched(df) if f.name not in by]
    cells = [_cell(f, table, i).alias(f"_c{i}") for i, f in enumerate(fields)]
    wide = df.groupBy(*by).agg(*[a for f in fields for a in _aggregates(f)])
    listed = wide.select(*by, F.explode(F.array(*cells)).alias("_c"))
    return listed.select(*by, "_c.*")


def _number(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    number = column.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def _aggregates(field: T.StructField) -> list[Column]:
    column, name = F.col(f"`{field.name}`"), field.name
    text = column.cast("string")
    hits = [F.count_if(matches(text, p)).alias(f"{name}/{p}") for p in VALUE_PATTERNS]
    common = [
        F.count(F.lit(1)).alias(f"{name}/rows"),
        F.count(column).alias(f"{name}/known"),
        F.hll_sketch_agg(text, F.lit(LG_K)).alias(f"{name}/hll"),
        *hits,
    ]
    if isinstance(field.dataType, _NUMBERS):
        number = _number(field)
        return [
            *common,
            F.min(number).alias(f"{name}/low"),
            F.max(number).alias(f"{name}/high"),
            F.count(number).alias(f"{name}/finite"),
            F.sum(number.try_cast(EXACT)).alias(f"{name}/sum"),
            F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias(f"{name}/kll"),
        ]
    return [*common, F.min(text).alias(f"{name}/low"), F.max(text).alias(f"{name}/high")]


def _cell(field: T.StructField, table: str, ordinal: int) -> Column:
    name, numeric = field.name, isinstance(field.dataType, _NUMBERS)

    def part(key: str, kind: str, here: bool = True) -> Column:
        return (F.col(f"`{name}/{key}`") if here else F.lit(None)).cast(kind)

    return F.struct(
        F.lit(table).alias("table_name"),
        F.lit(name).alias("column_name"),
        F.lit(ordinal).alias("ordinal"),
        part("rows", "bigint").alias("total_rows"),
        part("known", "bigint").alias("known"),
        part("hll", "binary").alias("hll"),
        part("low", "double", numeric).alias("low_number"),
        part("high", "double", numeric).alias("high_number"),
        part("finite", "bigint", numeric).alias("finite"),
        part("sum", EXACT, numeric).alias("total"),
        part("kll", "binary", numeric).alias("kll"),
        part("low", "string", not numeric).alias("low_text"),
        part("high", "string", not numeric).alias("high_text"),
        F.array(*[part(p, "bigint") for p in VALUE_PATTERNS]).alias("pattern_hits"),
    )


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of unions: one row per column (and value of ``by``) from any number of partitions."""
    hits = F.array(*[F.sum(F.col("pattern_hits")[i]) for i in range(len(VALUE_PATTERNS))])
    return sketches.groupBy(*by, *KEYS, "ordinal").agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("known").alias("known"),
        F.hll_union_agg("hll").alias("hll"),
        F.min("low_number").alias("low_number"),
        F.max("high_number").alias("high_number"),
        F.sum("finite").alias("finite"),
        F.sum("total").cast(EXACT).alias("total"),
        F.kll_merge_agg_double("kll").alias("kll"),
        F.min("low_text").alias("low_text"),
        F.max("high_text").alias("high_text"),
        hits.alias("pattern_hits"),
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """Readable profiles of sketch rows: exact counts, bounds and means, estimated distinct values and quantiles."""
    nulls = F.col("total_rows") - F.col("known")
    enough = F.greatest(F.lit(1), F.floor(F.col("known") / 2))
    hits = [F.when(F.col("pattern_hits")[i] >= enough, F.lit(p)) for i, p in enumerate(VALUE_PATTERNS)]
    some = F.col("finite") > 0
    quantiles = [
        F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(q).cast("double"))).alias(f"p{round(q * 100)}") for q in QUANTILES
    ]
    return sketches.select(
        *[c for c in sketches.columns if c not in _INNER],
        nulls.alias("null_count"),
        F.coalesce(ratio(nulls, F.col("total_rows"), 2, scale=100), F.lit(0.0)).alias("null_percentage"),
        F.when(F.col("known") > 0, F.hll_sketch_estimate("hll")).otherwise(0).alias("approx_distinct"),
        F.coalesce(shown_number(F.col("low_number")), "low_text").alias("min_value"),
        F.coalesce(shown_number(F.col("high_number")), "high_text").alias("max_value"),
        F.when(some, F.round(F.col("total") / F.col("finite"), 2).cast("double")).alias("avg_value"),
        *quantiles,
        F.array_compact(F.array(*hits)).alias("detected_patterns"),
    )


_INNER = ["known", "hll", "low_number", "high_number", "finite", "total", "kll", "low_text", "high_text", "pattern_hits"]


def refresh(df: DataFrame, table: str, by: Sequence[str], path: str, again: DataFrame | None = None) -> DataFrame:
    """Keeps the sketches of a partitioned table under ``path`` and returns those of all its partitions.

    Only partitions without a stored sketch are read, and those listed in ``again`` (``by``
    columns), whose rows have changed. Which are there shows from the partition columns alone. Each call
    adds a folder, whose rows replace older ones of the same partitions; partitions that are gone
    are left out.
    """
    spark = df.sparkSession
    present = df.select(*by).distinct()
    stored = _stored(spark, path)
    new = present if stored is None else present.join(stored.select(*by).distinct(), _same(by, present, stored), "left_anti")
    if again is not None:
        new = new.unionByName(present.join(again.select(*by).distinct(), list(by), "left_semi")).distinct()
    rows = [tuple(r) for r in new.collect()]  # a row per new partition
    if rows:
        wanted = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, r, strict=True)]) for r in rows])
        number = 0 if stored is None else stored.agg(F.max("call")).first()[0] + 1
        sketch(df.where(wanted), table, by).write.mode("overwrite").parquet(f"{path}/call={number}")
    every = _stored(spark, path)
    if every is None:
        return sketch(df, table, by)
    keys = [*by, *KEYS]
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in every.columns if c not in keys]), "call").alias("_s"))
    kept = latest.select(*keys, "_s.*").drop("call")
    return kept.join(present.withColumnsRenamed({c: f"_p_{c}" for c in by}), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in by]), "left_semi")


def _same(by: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in by])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return None
    return spark.read.parquet(path)
