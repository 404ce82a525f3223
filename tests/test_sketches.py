import random

from pyspark.sql import functions as F

from tabellion.operators import sketches

SCHEMA = "part string, k int, v double, t string, d date, arr array<int>"


def rows(seed, count=3000):
    import datetime as dt

    rng = random.Random(seed)
    return [
        (
            rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else rng.randrange(900),
            rng.choice([rng.gauss(5, 2), None, float("nan"), float("inf")]) if rng.random() < 0.1 else rng.gauss(5, 2),
            f"user{rng.randrange(2000)}@x.org", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(400)), [1],
        )
        for _ in range(count)
    ]


def shown(frame):
    return {r.column_name: r for r in sketches.estimates(frame).collect()}


def test_merged_sketches_equal_those_of_the_whole(spark):
    df = spark.createDataFrame(rows(1), SCHEMA).repartition(5)
    whole, merged = shown(sketches.sketch(df.drop("part"), "t")), shown(sketches.merge(sketches.sketch(df, "t", ["part"])))
    assert set(whole) == set(merged) == {"k", "v", "t", "d"}
    for name, one in whole.items():
        two = merged[name]
        for field in ("total_rows", "null_count", "null_percentage", "min_value", "max_value", "avg_value", "detected_patterns"):
            assert one[field] == two[field], (name, field)
        exact = df.select(F.countDistinct(name)).first()[0]
        for sketch in (one, two):  # one sketch and a union estimate a little differently
            assert abs(sketch.approx_distinct - exact) <= max(1, sketches.DISTINCT_ERROR * exact)
    finite = sorted(r[2] for r in rows(1) if r[2] is not None and r[2] == r[2] and abs(r[2]) != float("inf"))
    for q, value in ((0.25, merged["v"].p25), (0.5, merged["v"].p50), (0.75, merged["v"].p75)):
        assert abs(sum(x <= value for x in finite) / len(finite) - q) < sketches.RANK_ERROR
    assert merged["t"].detected_patterns == ["EMAIL_PATTERN"] and merged["t"].p50 is None


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([("a", None, None, None, None, None)] * 3, SCHEMA)
    found = shown(sketches.sketch(df, "t"))
    assert (found["k"].total_rows, found["k"].null_count, found["k"].approx_distinct, found["k"].p50, found["k"].min_value) == (3, 3, 0, None, None)
    assert shown(sketches.sketch(df.limit(0), "t"))["k"].total_rows == 0
    assert shown(sketches.merge(sketches.sketch(df.limit(0), "t", ["part"]))) == {}


def test_refresh_reads_new_partitions_only(spark, tmp_path):
    df = spark.createDataFrame(rows(2), SCHEMA)
    path = str(tmp_path / "sketches")
    first = sketches.refresh(df.where("part = 'a' or part is null"), "t", ["part"], path)
    assert first.select("part").distinct().count() == 2
    # rows of a stored partition that changed unnoticed are not read ...
    changed = df.withColumn("k", F.when(F.col("part") == "a", F.lit(7)).otherwise(F.col("k")))
    both = sketches.refresh(changed, "t", ["part"], path)
    distinct = df.select("k").distinct().count() - 1
    assert abs(shown(sketches.merge(both))["k"].approx_distinct - distinct) <= sketches.DISTINCT_ERROR * distinct
    # ... unless they are named
    again = sketches.refresh(changed, "t", ["part"], path, again=spark.createDataFrame([("a",)], "part string"))
    assert shown(sketches.merge(again.where("part = 'a'")))["k"].approx_distinct == 1
    assert again.count() == 4 * 4
    less = sketches.refresh(changed.where("part = 'b'"), "t", ["part"], path)
    assert {r.part for r in less.select("part").distinct().collect()} == {"b"}
