"""Ordered scans must not depend on whether a large group is cut into slices."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tabellion.functions.ordered import OrderedGroups


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(200), i, rng.choice([None, None, rng.randrange(9)])))
    data += [(None, 5, 9001, 1), (None, 6, 9002, None)]
    return spark.createDataFrame(data, "k string, t int, id int, v int").repartition(6).cache()


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.select(left.columns).collect()))


@pytest.mark.parametrize("limit", [50, 10_000])
def test_row_number(rows, limit):
    groups = OrderedGroups(rows, ["k"], ["t", "id"], limit)
    assert groups.split == (limit == 50)
    wanted = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("bigint"))
    same(wanted, groups.row_number("n"))


def test_descending_row_number_and_dense_rank(rows):
    window = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    wanted = rows.withColumn("n", F.row_number().over(window).cast("bigint")).withColumn(
        "r", F.dense_rank().over(Window.partitionBy("k").orderBy(F.desc("t"))).cast("bigint")
    )
    numbered = OrderedGroups(rows, ["k"], ["-t", "-id"], 50).row_number("n")
    same(wanted, OrderedGroups(numbered, ["k"], ["-t", "-id"], 50).dense_rank("r"))


@pytest.mark.parametrize("limit", [50, 10_000])
def test_last_known_and_previous_and_sum(rows, limit):
    window = Window.partitionBy("k").orderBy("t", "id")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    groups = OrderedGroups(rows, ["k"], ["t", "id"], limit)
    same(rows.withColumn("v", F.last("v", ignorenulls=True).over(upto)), groups.last_known(["v"]))
    same(
        rows.withColumns({"pv": F.lag("v").over(window), "pt": F.lag("t").over(window)}),
        groups.previous({"pv": "v", "pt": "t"}),
    )
    same(rows.withColumn("s", F.sum("id").over(upto)), groups.running_sum("id", "s"))
