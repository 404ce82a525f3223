import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabellion.functions.ordered import SLICE, OrderedGroups
from tabellion.operators import admission, evaluate


def test_result_comparison(spark):
    left = spark.createDataFrame([(1, "A ", 1.001), (1, "A ", 1.001), (2, None, None)], "k int, s string, v double")
    right = spark.createDataFrame([(None, 2.0, "null"), ("a", 1.0, "1.00"), ("a", 1.0, "1.00")], "s string, k double, v string")
    same = spark.createDataFrame([(2.0, None, None), (1.0, "a", 1.0), (1.0, " A", 1.0)], "x double, y string, z double")
    assert evaluate.result_diff(left, same).first().equal
    other = evaluate.result_diff(left, same.limit(2)).first()
    assert not other.equal and other.missing_rows == 1
    assert not evaluate.result_diff(left, right).first().equal
    assert evaluate.result_diff(left.limit(0), same.limit(0)).first().equal


def test_metrics_are_zero_safe(spark):
    df = spark.createDataFrame([(False, False)], "a boolean, p boolean")
    row = evaluate.confusion(df, F.col("a"), F.col("p")).first()
    assert (row.precision, row.recall, row.f1_score, row.tn) == (0.0, 0.0, 0.0, 1)
    df = spark.createDataFrame([(True, True)] * 25 + [(False, True)] + [(True, False)] * 2, "a boolean, p boolean")
    row = evaluate.confusion(df, F.col("a"), F.col("p")).first()
    assert (row.precision, row.recall, row.f1_score) == (0.9615, 0.9259, 0.9434)


def test_answers(spark):
    gold = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "question int, row string")
    answers = spark.createDataFrame(
        [("full", 1, "y"), ("full", 1, "x"), ("full", 1, "x"), ("full", 2, "z"), ("bare", 1, "x"), ("bare", 1, "y")],
        "condition string, question int, row string",
    )
    matches = evaluate.answer_matches(answers, gold)
    rows = {r.condition: r for r in evaluate.ablation(evaluate.answer_accuracy(matches, gold), "full").collect()}
    assert rows["full"].accuracy_pct == 100.0 and rows["bare"].accuracy_pct == 0.0 and rows["bare"].drop_points == -100.0


def test_json_in_text(spark):
    texts = ['x ```json\n{"a": 1}\n``` {no}', 'say {"a": {"b": 2}} end', "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(evaluate.extract_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None]


def requests(n, seed):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 2, 3, 40]))
        rows.append(("busy" if rng.random() < 0.7 else f"c{rng.randrange(5)}", at, i))
    return rows


def brute_force(rows, limit, window):
    accepted, verdicts = {}, {}
    for client, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        recent = [t for t in accepted.get(client, []) if (at - t).total_seconds() < window]
        verdicts[i] = len(recent) < limit
        accepted[client] = [*recent, at] if verdicts[i] else recent
    return verdicts


@pytest.mark.parametrize("group_rows", [40, 10_000])
def test_admission_equals_brute_force(spark, group_rows):
    rows = requests(600, 3)
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id int")
    got = {r.id: r.accepted for r in admission.admit(df, "client", "ts", "id", 4, 30, group_rows).collect()}
    assert got == brute_force(rows, 4, 30)


@pytest.mark.parametrize("group_rows", [40, 10_000])
def test_load_equals_brute_force(spark, group_rows):
    rows = requests(500, 4)
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id int")
    got = {r.id: r.load for r in admission.trailing_load(df, "client", "ts", 30, group_rows).collect()}
    wanted = {i: sum(1 for c, t, _ in rows if c == client and 0 <= (at - t).total_seconds() < 30) for client, at, i in rows}
    assert got == wanted


@pytest.mark.parametrize("group_rows", [5, 10_000])
def test_requests_without_a_client_are_one_client(spark, group_rows):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 2 else "a", start + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, client string, ts timestamp_ntz")
    named = df.fillna({"client": "b"})
    for found, same in (
        (admission.admit(df, "client", "ts", "id", 3, 10, group_rows), admission.admit(named, "client", "ts", "id", 3, 10, group_rows)),
        (admission.trailing_load(df, "client", "ts", 10, group_rows), admission.trailing_load(named, "client", "ts", 10, group_rows)),
    ):
        value = found.columns[-1]
        assert {r.id: r[value] for r in found.collect()} == {r.id: r[value] for r in same.collect()}
        assert found.count() == 40 and sorted(found.columns) == sorted([*df.columns, value])


def test_a_client_that_is_never_idle_needs_few_rounds(spark):
    """Verdicts that depend on all earlier ones: the state never forgets where the client began."""
    start = dt.datetime(2024, 1, 1)
    rows = [("busy", start + dt.timedelta(seconds=7 * i), i) for i in range(640)] + [("calm", start + dt.timedelta(days=i), 1000 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id int")
    got = {r.id: r.accepted for r in admission.admit(df, "client", "ts", "id", 3, 50, 20).collect()}
    assert got == brute_force(rows, 3, 50)
    timed = df.withColumn("_at", admission.micros("ts"))
    groups = OrderedGroups(timed, ["client"], ["_at", "id"], 20)
    slices = groups.frame.where("client = 'busy'").select(SLICE).distinct().count()
    _, rounds = admission._settled_states(groups.frame.select("client", "id", "_at", SLICE), "client", "id", "string", 3, 50 * admission.MICROS)
    assert slices > 50 and rounds <= slices.bit_length() + 1


def test_equal_results_shuffle_checksums_only(spark):
    rows = spark.range(20_000).selectExpr("id % 700 AS k", "concat('text ', id) AS t", "id / 3 AS v")
    found = evaluate.result_diff(rows, rows.orderBy("t").repartition(5), buckets=64).first()
    assert tuple(found) == (20_000, 20_000, 0, 0, True)
    changed = rows.where("k <> 5").unionAll(rows.where("k = 6"))
    found = evaluate.result_diff(rows, changed, buckets=8).first()
    lost, more = rows.where("k = 5").count(), rows.where("k = 6").count()
    assert tuple(found) == (20_000, 20_000 - lost + more, lost, more, False)
    assert tuple(evaluate.result_diff(rows, rows.select("k", "t")).first())[2:4] == (20_000, 20_000)


def test_pii_metrics_read_the_tables_once(spark, tmp_path):
    import __spark_entry__ as entry
    from tabellion.plans.schemas import SCHEMAS

    for table, columns in SCHEMAS.items():
        nulls = [tuple(None for _ in columns)] * 3
        frame = spark.createDataFrame(nulls, ", ".join(f"{name} {kind}" for name, kind in columns))
        frame.write.parquet(str(tmp_path / f"{table}.parquet"))
    found = entry.queries()["pii_eval"](spark, str(tmp_path))
    assert "Scan parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r.total_evaluated for r in found.collect()) == sum(len(c) for c in SCHEMAS.values())
