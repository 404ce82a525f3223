"""Runs registered queries on Spark and their oracle SQL on DuckDB and compares the rows.

    python tests/oracle_check.py [scale] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TABELLION_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    df = query(spark, folder)
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    mine = sorted(tuple(cell(r[i]) for i in order) for r in df.collect())
    if sql is None:
        return f"rows-only ({len(mine)})"
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(theirs_names):
        return f"FAIL columns {sorted(names)} vs {sorted(theirs_names)}"
    their_order = sorted(range(len(theirs_names)), key=lambda i: theirs_names[i])
    theirs = sorted(tuple(cell(r[i]) for i in their_order) for r in result.fetchall())
    pairs = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    mismatched = [(c, t, types[c]) for c, t in df.dtypes if pairs.get(types[c], types[c]) != t]
    if mine != theirs:
        extra = sorted(set(mine) - set(theirs))[:2]
        missing = sorted(set(theirs) - set(mine))[:2]
        return f"FAIL rows {len(mine)} vs {len(theirs)}\n   spark only {extra}\n   oracle only {missing}\n   types {mismatched}"
    if mismatched:
        return f"FAIL types {mismatched}"
    if not mine:
        return "FAIL empty"
    return f"ok ({len(mine)})"


def main() -> int:
    import __spark_entry__ as entry
    from tabellion.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"{DATA}/sf{scale}"
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            outcome = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as error:
            outcome = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        if outcome.startswith("FAIL"):
            failed.append(name)
        print(f"{name}: {outcome} [{time.time() - start:.1f}s]", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
