import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewash.operators import joins
from tablewash.types import ColumnNameClashError, InvalidValueError, NoJoinColumnsError, TypeMismatchError


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, l string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, "x"), (2, "y"), (1, "z"), (None, "n"), (7, "m")], "j int, r string")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_against_plain_join(left, right, how):
    want = left.join(right, left.k == right.j, how).collect()
    got = joins.normal_join(left, right, ["k"], ["j"], how).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    shared = right.withColumnRenamed("j", "k")
    want = left.join(shared, on=["k"], how=how).collect()
    got = joins.natural_join(left, shared, how)
    assert got.columns == ["k", "l", "r"] and sorted(map(str, got.collect())) == sorted(map(str, want))


def test_hot_key(spark):
    left = spark.range(3000).selectExpr("if(id < 1000, 0, id) AS k", "id AS a")
    right = spark.range(50).selectExpr("id AS j", "id * 2 AS b")
    assert joins.normal_join(left, right, ["k"], ["j"], "full").count() == 3000 + 49
    assert joins.normal_join(right, left, ["j"], ["k"], "left").count() == 1000 + 49


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_hot_keys_of_both_sides(spark, how):
    """Hot keys that both sides have, that one side has, NULL keys, and two columns, one of them NULL."""
    rng = random.Random(6)

    def keys(hot, n):
        return [(rng.choice([hot, hot, None, n % 7, 50 + n]), rng.choice(["x", "x", None, "y"])) for n in range(200)]

    left = spark.createDataFrame([(*k, n) for n, k in enumerate(keys(1, 0))], "a int, b string, l int").repartition(4)
    right = spark.createDataFrame([(*k, n) for n, k in enumerate(keys(2, 0) + keys(1, 0)[:60])], "c int, d string, r int").repartition(4)
    want = left.join(right, (left.a == right.c) & (left.b == right.d), how).collect()
    for hot_rows in (5, 50, 10 ** 6):
        got = joins.normal_join(left, right, ["a", "b"], ["c", "d"], how, hot_rows).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    want = left.drop("b").join(right.drop("d").withColumnRenamed("c", "a"), on=["a"], how=how).collect()
    got = joins.natural_join(left.drop("b"), right.drop("d").withColumnRenamed("c", "a"), how, 5)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want)) and got.columns == ["a", "l", "r"]


def test_no_task_reads_a_hot_key(spark, monkeypatch):
    """One key with 40 % of the side that can't be split by Spark: its rows are dealt over many partitions."""
    left = spark.range(2000).selectExpr("id AS k", "id AS a")
    right = spark.range(20_000).selectExpr("if(id % 5 < 2, 7, id) AS j", "id AS b")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = {}
        for hot_rows in (500, 10 ** 9):
            joined = joins.normal_join(left, right, ["k"], ["j"], "left", hot_rows)
            assert joined.select("k").distinct().count() == 2000
            held = joined.withColumn("part", F.spark_partition_id()).where("k = 7").groupBy("part").count().collect()
            sizes[hot_rows] = max(row["count"] for row in held)
            assert sum(row["count"] for row in held) == 8001
        assert sizes[500] < 3000 and sizes[10 ** 9] == 8001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_semi_join(left, right):
    assert sorted(r["l"] for r in joins.semi_join(left, right, "k", "j").collect()) == ["a", "b", "c"]


def test_checks(left, right):
    with pytest.raises(TypeMismatchError):
        joins.normal_join(left, right, ["k"], ["r"])
    with pytest.raises(ColumnNameClashError):
        joins.normal_join(left, left, ["k"], ["k"])
    with pytest.raises(NoJoinColumnsError):
        joins.natural_join(left, right)
    with pytest.raises(TypeMismatchError):
        joins.natural_join(left, right.withColumnRenamed("r", "k"))
    with pytest.raises(InvalidValueError):
        joins.normal_join(left, right, ["k"], ["j"], "cross")
    with pytest.raises(InvalidValueError):
        joins.normal_join(left, right, [], [])
