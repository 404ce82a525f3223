"""Column profiles of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabellion.functions.columns import joined
from tabellion.functions.patterns import VALUE_PATTERNS
from tabellion.operators import profile, sketches
from tabellion.plans.binding import Estate
from tabellion.plans.oracle import define, half_up
from tabellion.plans.registry import query, register
from tabellion.plans.schemas import SCHEMAS
from tabellion.session import scratch_path

NUMBERS = ("int", "bigint", "double")


def shown(expression: str, kind: str) -> str:
    if kind == "double":
        return f"regexp_replace(CAST(CAST({expression} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"
    return f"CAST({expression} AS VARCHAR)"


def strip(expression: str) -> str:
    return f"trim({expression}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def pattern_list(samples: str) -> str:
    parts = [
        f"CASE WHEN len(list_filter({samples}, lambda s: regexp_matches({strip('s')}, '{p}'))) >= greatest(1, len({samples}) // 2) THEN '{name}' END"
        for name, p in VALUE_PATTERNS.items()
    ]
    return f"list_filter([{', '.join(parts)}], lambda p: p IS NOT NULL)"


def column_profile(table: str, ordinal: int, column: str, kind: str, values: str | None = None) -> str:
    """Oracle profile of one column, from an aggregate over the column and a list of its smallest values."""
    source = values or f"SELECT {column} AS v FROM {table}"
    mean = (
        "(SIGN(SUM(CAST(v AS DECIMAL(28,6)))) * CAST((2 * ABS(SUM(CAST(CAST(v AS DECIMAL(18,6)) * 1000000 AS HUGEINT))) + 10000 * COUNT(v))"
        " // NULLIF(20000 * COUNT(v), 0) AS DOUBLE) / 100)"
        if kind in NUMBERS
        else "CAST(NULL AS DOUBLE)"
    )
    least, most = shown("MIN(v)", kind), shown("MAX(v)", kind)
    listed = f"COALESCE(list({shown('d', kind)} ORDER BY d), CAST([] AS VARCHAR[]))"
    if kind.startswith("array"):  # nested values have counts only
        least = most = "CAST(NULL AS VARCHAR)"
        listed = "CAST([] AS VARCHAR[])"
    neighbours = ", ".join(f"'{c}'" for c, _ in SCHEMAS[table] if c != column)
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, CAST({ordinal} AS INTEGER) AS ordinal, '{kind}' AS data_type,
    COUNT(*) AS total_rows, COUNT(*) - COUNT(v) AS null_count, COUNT(DISTINCT v) AS distinct_count,
    {least} AS min_value, {most} AS max_value, {mean} AS avg_value,
    (SELECT {listed} FROM (SELECT DISTINCT v AS d FROM ({source}) WHERE v IS NOT NULL ORDER BY d LIMIT 5){' LIMIT 1' if kind.startswith('array') else ''}) AS sample_values,
    CAST([{neighbours}] AS VARCHAR[]) AS neighbor_columns FROM ({source})"""


def profile_sql(columns: list[str]) -> str:
    raw = "\nUNION ALL\n".join(columns)
    return f"""SELECT *, COALESCE({half_up('null_count', 'total_rows', 2, 100)}, 0.0) AS null_percentage,
    COALESCE({half_up('distinct_count', 'total_rows', 4)}, 0.0) AS cardinality_ratio,
    distinct_count = total_rows AND null_count = 0 AS is_unique,
    {pattern_list('sample_values')} AS detected_patterns FROM ({raw})"""


def table_profile_sql(*tables: str) -> str:
    return profile_sql([column_profile(t, i, c, k) for t in tables for i, (c, k) in enumerate(SCHEMAS[t])])


define("estate_profile", table_profile_sql(*SCHEMAS))


def flat(profiles: DataFrame) -> DataFrame:
    """Profiles with their list columns as text."""
    return profiles.withColumns(
        {c: joined(F.col(c)) for c in ("sample_values", "detected_patterns", "neighbor_columns")}
    )


def flat_sql(source: str) -> str:
    return f"""SELECT * REPLACE (array_to_string(sample_values, '|') AS sample_values,
    array_to_string(detected_patterns, '|') AS detected_patterns,
    array_to_string(neighbor_columns, '|') AS neighbor_columns) FROM {source}"""


def estate_profile(e: Estate) -> DataFrame:
    return profile.profile_tables({t: e.table(t) for t in SCHEMAS})


for table_name in ("customer", "orders", "lineitem"):
    register(
        f"profile_{table_name}",
        lambda e, t=table_name: flat(profile.profile_table(e.table(t), t)),
        flat_sql(f"({table_profile_sql(table_name)})"),
    )

register("profile_estate", lambda e: flat(estate_profile(e)), flat_sql("estate_profile"))


@query(
    "profile_samples",
    f"SELECT table_name, column_name, CAST(i AS INTEGER) AS position, sample_values[i] AS sample_value FROM ({table_profile_sql('part')}), generate_series(1, 5) AS g(i) WHERE i <= len(sample_values)",
)
def profile_samples(e: Estate) -> DataFrame:
    found = profile.profile_table(e.table("part"), "part")
    return found.select("table_name", "column_name", F.posexplode("sample_values").alias("position", "sample_value")).withColumn(
        "position", F.col("position") + 1
    )


def pattern_hits(table: str, column: str, kind: str) -> str:
    hits = ", ".join(
        f"COUNT(*) FILTER (WHERE regexp_matches({strip(shown('v', kind))}, '{p}')) AS {name}" for name, p in VALUE_PATTERNS.items()
    )
    found = ", ".join(f"CASE WHEN {name} >= greatest(1, n // 2) THEN '{name}' END" for name in VALUE_PATTERNS)
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
    array_to_string(list_filter([{found}], lambda p: p IS NOT NULL), '|') AS detected_patterns
    FROM (SELECT COUNT(*) AS n, {hits} FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE {column} IS NOT NULL))"""


@query(
    "profile_patterns",
    "\nUNION ALL\n".join(pattern_hits("orders", c, k) for c, k in SCHEMAS["orders"]),
)
def profile_patterns(e: Estate) -> DataFrame:
    found = profile.profile_table(e.table("orders"), "orders", patterns_from="values")
    return found.select("table_name", "column_name", joined(F.col("detected_patterns")).alias("detected_patterns"))


@query(
    "profile_column_orders_orderdate",
    flat_sql(f"({profile_sql([column_profile('orders', 4, 'o_orderdate', 'timestamp_ntz')])})"),
)
def profile_one_column(e: Estate) -> DataFrame:
    return flat(profile.profile_column(e.table("orders"), "orders", "O_Order-Date"))


def sketch_sql(table: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS total_rows, COUNT(*) - COUNT({c}) AS null_count,
        {shown(f'MIN({c})', k)} AS min_value, {shown(f'MAX({c})', k)} AS max_value, TRUE AS near_exact FROM {table}"""
        for c, k in SCHEMAS[table]
    )


@query("profile_sketch_lineitem", sketch_sql("lineitem"))
def profile_sketch_lineitem(e: Estate) -> DataFrame:
    """The sketch, and whether its distinct counts are within a tenth of the exact ones."""
    sketch = profile.profile_sketch(e.table("lineitem"), "lineitem")
    exact = profile.profile_table(e.table("lineitem"), "lineitem").select("column_name", "distinct_count")
    off = F.abs(F.col("approx_distinct") - F.col("distinct_count"))
    near = (off <= F.greatest(F.lit(1.0), F.col("distinct_count") * 0.1)).alias("near_exact")
    return sketch.join(exact, "column_name").select(
        "table_name", "column_name", "total_rows", "null_count", "min_value", "max_value", near
    )


def merged_sql(table: str, by: str) -> str:
    parts = []
    for c, k in SCHEMAS[table]:
        if c == by:
            continue
        mean = half_up(f"SUM(CAST({c} AS DECIMAL(38,6)))", f"COUNT({c})", 2) if k in NUMBERS else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"""SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(COUNT(*) AS BIGINT) AS total_rows, COUNT(*) - COUNT({c}) AS null_count,
            {shown(f'MIN({c})', k)} AS min_value, {shown(f'MAX({c})', k)} AS max_value, {mean} AS avg_value, TRUE AS distinct_near, TRUE AS quantiles_near FROM {table}"""
        )
    return "\nUNION ALL\n".join(parts)


def checked(df: DataFrame, found: DataFrame) -> DataFrame:
    """Merged sketches with their errors tested: distinct values and ranks of the quartiles, against the whole table."""
    exact = profile.profile_table(df, "exact").select("column_name", "distinct_count")
    off = F.abs(F.col("approx_distinct") - F.col("distinct_count"))
    near = off <= F.greatest(F.lit(1.0), F.col("distinct_count") * sketches.DISTINCT_ERROR)
    # one row per column: three numbers for each quantile
    quartiles = [(r.column_name, q, r[f"p{round(q * 100)}"]) for r in found.where("p50 is not null").collect() for q in sketches.QUANTILES]
    if not quartiles:
        return found.limit(0)
    ranks = df.agg(*[
        ((F.avg((F.col(c) < v).cast("int")) - sketches.RANK_ERROR <= q) & (F.avg((F.col(c) <= v).cast("int")) + sketches.RANK_ERROR >= q)).alias(f"q{i}")
        for i, (c, q, v) in enumerate(quartiles)
    ])
    listed = ranks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"q{i}").alias("ok")) for i, (c, _, _) in enumerate(quartiles)])).alias("r"))
    good = listed.groupBy("r.column_name").agg(F.bool_and("r.ok").alias("_good"))
    return found.join(exact, "column_name").join(good, "column_name", "left").select(
        "table_name", "column_name", "total_rows", "null_count", "min_value", "max_value", "avg_value", near.alias("distinct_near"),
        F.coalesce("_good", F.lit(True)).alias("quantiles_near"),
    )


@query("profile_sketch_merged", merged_sql("lineitem", "l_returnflag"))
def profile_sketch_merged(e: Estate) -> DataFrame:
    """Sketches of each return flag's line items, merged into the table's, and whether they keep their error bounds."""
    items = e.table("lineitem")
    return checked(items, sketches.estimates(sketches.merge(sketches.sketch(items, "lineitem", ["l_returnflag"]))))


@query("profile_sketch_refreshed", merged_sql("orders", "o_orderstatus"))
def profile_sketch_refreshed(e: Estate) -> DataFrame:
    """A stored profile that a new partition is added to; the old ones are not read again."""
    orders, path = e.table("orders"), scratch_path(e.spark, "sketches")
    sketches.refresh(orders.where("o_orderstatus <> 'P'"), "orders", ["o_orderstatus"], path)
    stored = sketches.refresh(orders, "orders", ["o_orderstatus"], path)
    return checked(orders, sketches.estimates(sketches.merge(stored)))
