from tabellion.operators import defects, quality
from tabellion.operators.quality import Rule


def table(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (2, None, 50.0), (None, "12", None)], "id int, name string, price double")


def run(spark, *rules, **more):
    return {r.rule_type: r for r in quality.run_rules({"t": table(spark), **more}, rules).collect()}


def test_rules(spark):
    parent = spark.createDataFrame([(1,)], "id int")
    found = run(
        spark,
        Rule("t", "NOT_NULL", "name"),
        Rule("t", "UNIQUE", "id"),
        Rule("t", "RANGE_CHECK", "price", low=2, high=10),
        Rule("t", "PATTERN_MATCH", "name", pattern=r"^[a-z]\z"),
        Rule("t", "REFERENTIAL_INTEGRITY", "id", ref_table="p", ref_column="id"),
        p=parent,
    )
    counts = {k: v.failing_rows_count for k, v in found.items()}
    assert counts == {"NOT_NULL": 1, "UNIQUE": 1, "RANGE_CHECK": 2, "PATTERN_MATCH": 1, "REFERENTIAL_INTEGRITY": 2}
    assert all(v.total_rows_count == 4 and not v.passed for v in found.values())


def test_patterns_are_run_as_given(spark):
    zips = spark.createDataFrame([("zzzzz",), ("ZIP1",), ("12345",), ("1234-567",), (None,)], "z string")
    rules = [Rule("z", "PATTERN_MATCH", "z", "WARNING", pattern=p) for p in (r"^ZIP[0-9]$", "ZIP_PATTERN")]
    assert [r.failing_rows_count for r in quality.run_rules({"z": zips}, rules).collect()] == [3, 2]


def test_score_and_gate(spark):
    rules = [Rule("t", "RANGE_CHECK", "price", "WARNING", low=0, high=100), Rule("t", "NOT_NULL", "id", "ERROR")]
    names = spark.createDataFrame([("t",), ("empty",)], "table_name string")
    scores = {r.table_name: r for r in quality.score_tables(quality.run_rules({"t": table(spark)}, rules), names).collect()}
    assert scores["t"].quality_score == 0.333 and not scores["t"].can_certify
    assert scores["empty"].quality_score == 1.0 and scores["empty"].can_certify


def test_row_rules_share_one_scan(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [Rule("t", "NOT_NULL", c) for c in df.columns] + [Rule("t", "RANGE_CHECK", "price", low=0, high=1)]
    found = quality.run_rules({"t": df}, rules)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1


def test_defects_are_counted_and_caught(spark):
    clean = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, amount double")
    seeded = [
        defects.Defect("D1", "NULL_VALUE", "t", "id", "id", 3, defects.overwrite("id", "NULL")),
        defects.Defect("D2", "OUT_OF_RANGE", "t", "amount", "amount", 2, defects.overwrite("amount", "-1.0")),
        defects.Defect("D3", "DUPLICATE_KEY", "u", "id", "id", 4, defects.duplicate),
    ]
    rules = [Rule("t", "NOT_NULL", "id"), Rule("u", "UNIQUE", "id"), Rule("u", "RANGE_CHECK", "amount", low=0, high=5)]
    found, report = defects.benchmark({"t": clean, "u": clean}, seeded, {"all": rules})
    assert {(r.defect_id, r.injected_count, r.caught) for r in found.collect()} == {("D1", 3, True), ("D2", 2, False), ("D3", 4, True)}
    totals = report.first()
    assert totals.catch_rate_percentage == 66.67 and totals.false_positives == 1


def test_key_rules_of_all_tables_share_one_shuffle(spark, tmp_path):
    spark.createDataFrame([(i % 40, f"k{i % 7}", 0.0 if i % 2 else -0.0) for i in range(100)], "id int, name string, v double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(i, f"k{i}") for i in range(5)], "id long, name string").write.parquet(str(tmp_path / "p"))
    t, p = (spark.read.parquet(str(tmp_path / n)) for n in "tp")
    rules = [
        Rule("t", "UNIQUE", "id"),
        Rule("t", "UNIQUE", "name", columns=("id", "name")),
        Rule("t", "UNIQUE", "v"),
        Rule("t", "REFERENTIAL_INTEGRITY", "id", ref_table="p", ref_column="id"),
        Rule("t", "REFERENTIAL_INTEGRITY", "name", ref_table="p", ref_column="name"),
        Rule("p", "UNIQUE", "id"),
    ]
    found = quality.run_rules({"t": t, "p": p}, rules)
    bad = {(r.table_name, r.rule_type, r.column_name): r.failing_rows_count for r in found.collect()}
    names = sum(i % 7 >= 5 for i in range(100))
    assert bad == {
        ("t", "UNIQUE", "id"): 60, ("t", "UNIQUE", "id,name"): 0, ("t", "UNIQUE", "v"): 99, ("p", "UNIQUE", "id"): 0,
        ("t", "REFERENTIAL_INTEGRITY", "id"): sum(i % 40 >= 5 for i in range(100)), ("t", "REFERENTIAL_INTEGRITY", "name"): names,
    }
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2
    assert plan.count("hashpartitioning(rule") <= 3 and plan.count("hashpartitioning(rule#") >= 1


def test_key_rules_with_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a:1"), (1, None)], "a int, b string")
    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", "bc")], "x string, y string")
    rules = [
        Rule("r", "UNIQUE", "a", columns=("a", "b")), Rule("r", "UNIQUE", "a"), Rule("e", "UNIQUE", "a"), Rule("s", "UNIQUE", "x", columns=("x", "y")),
        Rule("r", "REFERENTIAL_INTEGRITY", "a", ref_table="e", ref_column="a"),
    ]
    found = quality.run_rules({"r": rows, "e": rows.limit(0), "s": pairs}, rules).collect()
    got = {(r.table_name, r.rule_type, r.column_name): (r.failing_rows_count, r.total_rows_count) for r in found}
    assert got == {
        ("r", "UNIQUE", "a,b"): (0, 4), ("r", "UNIQUE", "a"): (1, 4), ("e", "UNIQUE", "a"): (0, 0), ("s", "UNIQUE", "x,y"): (1, 3),
        ("r", "REFERENTIAL_INTEGRITY", "a"): (2, 4),
    }
