"""Reading and writing tables: Parquet, CSV with declared types, JSON bundles, SQL over views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tabellion.functions.ordered import OrderedGroups


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null_value: str = "NULL") -> DataFrame:
    """Header CSV with declared types: no inference pass, and ``null_value`` reads as null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_value)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, null_value: str = "NULL") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", null_value).csv(path)


def first_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The row-capped sample of a source: its first ``rows`` rows by ``order``."""
    return df.orderBy(*order).limit(rows)


def first_rows_per(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows of every source, cut before the shuffle by a per-task top-k."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= rows).drop("_n")


def write_lakehouse(tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, list[str]] | None = None) -> None:
    """One Parquet dataset per table; ``partition_by`` gives the partition columns of wide ones."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        for_table = (partition_by or {}).get(name)
        if for_table:
            writer = writer.partitionBy(*for_table)
        writer.parquet(f"{folder}/{name}")


def open_lakehouse(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def query_lakehouse(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Ad-hoc SQL over named tables; each ``{name}`` in the text stands for that table."""
    return spark.sql(sql, **tables)


def materialise(spark: SparkSession, models: Mapping[str, tuple[list[str], object]], sources: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Builds declared models in dependency order and stores each as a Parquet table.

    ``models`` maps a name to (inputs, function of those inputs).
    """
    built: dict[str, DataFrame] = dict(sources)
    waiting = dict(models)
    while waiting:
        ready = [n for n, (inputs, _) in waiting.items() if all(i in built for i in inputs)]
        if not ready:
            raise ValueError(f"models with unknown or circular inputs: {sorted(waiting)}")
        for name in ready:
            inputs, build = waiting.pop(name)
            build(*[built[i] for i in inputs]).write.mode("overwrite").parquet(f"{folder}/{name}")
            built[name] = spark.read.parquet(f"{folder}/{name}")
    return {name: built[name] for name in models}


def write_bundle(entities: Mapping[str, DataFrame], folder: str) -> None:
    """A catalog bundle: one JSON-lines dataset per entity, replaced on every push."""
    for name, df in entities.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, schemas: Mapping[str, StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def merge_by_key(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "upsert") -> DataFrame:
    """Catalog sync of one entity table.

    ``upsert`` keeps the stored value where the update is null, ``replace`` takes the updated
    row whole, ``append`` adds rows. Updates must hold at most one row per key.
    """
    if mode == "append":
        return target.unionByName(updates, allowMissingColumns=True)
    if mode not in ("upsert", "replace"):
        raise ValueError(f"unknown sync mode {mode!r}")
    old, new = target.alias("old"), updates.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = old.join(new, on, "full_outer")
    updated = F.col(f"new.{keys[0]}").isNotNull()
    columns = []
    for name in target.columns:
        kept = F.col(f"old.{name}")
        if name not in updates.columns:
            columns.append(kept.alias(name))
        elif mode == "replace" and name not in keys:
            columns.append(F.when(updated, F.col(f"new.{name}")).otherwise(kept).alias(name))
        else:
            columns.append(F.coalesce(F.col(f"new.{name}"), kept).alias(name))
    return both.select(*columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, as one aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return OrderedGroups(df, keys, order).row_number(name)
