import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewash.functions import ordering
from tablewash.operators import discretize, encode, impute, profile, rows
from tablewash.types import AttrTypeError, InvalidValueError


def labels(df, column):
    counted = df.groupBy(column).count().collect()
    return {row[column]: row["count"] for row in counted}


def test_one_hot(companies):
    once = encode.one_hot_encode(companies, "string")
    assert len(once.columns) == 22 and once.columns[6:] == sorted(r["string"] for r in companies.collect())
    assert len(encode.one_hot_encode(once, "date_string").columns) == 35
    assert once.agg(F.sum("Apple")).first()[0] == 1
    with pytest.raises(InvalidValueError, match="more than 3"):
        encode.one_hot_encode(companies, "string", max_categories=3)


def test_one_hot_null_and_clash(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in encode.one_hot_encode(df, "v").collect()] == [(1, 0), (0, 0), (0, 1)]
    with pytest.raises(InvalidValueError):
        encode.one_hot_encode(df.withColumn("a", F.lit(1)), "v")


def test_flags_are_read_back_without_an_array_for_each_row(spark, tmp_path):
    from tablewash.acceptance import QUERIES

    # Nothing to encode, and parts of three categories with rows of none.
    for name, keys in (("none", [11, 22]), ("some", [1, 501, 2, 11, 3])):
        rows_ = [(key, 10.0 * place) for place, key in enumerate(keys, 1)]
        spark.createDataFrame(rows_, "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got = QUERIES["one_hot_many"](spark, f"{tmp_path}/{name}")
        assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = [] if name == "none" else [("p1", 2, 30), ("p2", 1, 30), ("p3", 1, 50)]
        assert sorted(map(tuple, got.collect())) == want


def test_one_hot_of_many_and_new_values(spark):
    values = [f"v{n}" for n in range(300)]
    df = spark.createDataFrame([(v,) for v in values for _ in range(2)] + [(None,)], "v string")
    params = encode.fit_one_hot(df, "v")
    assert params["categories"] == sorted(values)
    got = encode.apply_one_hot(df.unionByName(spark.createDataFrame([("v", ), ("v30x",), ("zzz",), ("",)], "v string")), "v", params)
    assert got.columns == sorted(values)
    sums = got.agg(*[F.sum(F.col(name)).alias(name) for name in got.columns]).first()
    assert set(sums) == {2} and got.where(F.array_max(F.array(*got.columns)) == 0).count() == 5
    assert encode.one_hot_encode(df.limit(0).withColumn("n", F.lit(1)), "v").columns == ["n"]
    with pytest.raises(InvalidValueError, match="more than 299"):
        encode.fit_one_hot(df, "v", 299)
    with pytest.raises(InvalidValueError, match="more than 2000"):
        encode.fit_one_hot(spark.range(2001).withColumn("id", F.col("id").cast("string")), "id")


@pytest.mark.parametrize("kind", ["double", "decimal(8,2)", "date", "timestamp", "binary", "string"])
def test_one_hot_of_many_values_of_each_type(spark, kind):
    value = F.expr("timestamp_seconds(id * 86400)" if kind in ("date", "timestamp") else "id").cast(
        "string" if kind == "binary" else kind).cast(kind)
    df = spark.range(70).select("id", F.when(F.col("id") > 0, value).alias("v")).unionByName(
        spark.range(70, 72).select("id", F.when(F.lit(kind == "double"), F.lit("NaN")).cast(kind).alias("v")))
    got = encode.one_hot_encode(df, "v")
    names = got.columns[1:]
    assert len(names) == 69 and {t for _, t in got.dtypes[1:]} == {"int"}
    rows = {r["id"]: [r[name] for name in names] for r in got.collect()}
    assert len(rows) == 72 and all(sum(rows[n]) == (1 if 0 < n < 70 else 0) for n in rows)
    assert len({tuple(rows[n]) for n in range(1, 70)}) == 69
    # Many values are looked up once a row; few are compared in place.
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    few = encode.one_hot_encode(df.where("id < 9"), "v")
    assert "Join" not in few._jdf.queryExecution().toString()


def test_zscore(companies):
    params = encode.fit_zscore(companies, "number")
    assert params["mean"] == 9.9375 and round(params["deviation"], 10) == 12.1987127907
    scored = encode.zscore_normalize(companies, "number")
    assert scored.select("number").distinct().count() == 14
    assert encode.zscore_normalize(companies, "number", low_clamp="symmetric").select("number").distinct().count() == 15
    found = {r["string"]: r["number"] for r in scored.collect()}
    assert found["Elevate ltd"] == found["Dummy"] == 1.0
    added = encode.zscore_normalize(companies, "number", overwrite=False)
    assert added.columns[-1] == "number_normalized" and added.select("number").schema == companies.select("number").schema
    with pytest.raises(AttrTypeError):
        encode.zscore_normalize(companies, "string")


def test_zscore_without_spread(spark):
    df = spark.createDataFrame([(5,), (5,), (None,)], "v int")
    assert [r["v"] for r in encode.zscore_normalize(df, "v").collect()] == [5.0, 5.0, None]


def test_equal_width(companies):
    df = discretize.bin_equal_width(companies, "number", 4)
    assert labels(df, "number_categorical") == {"[-17 , -2[": 2, "[-2 , 13[": 9, "[13 , 28[": 4, "[28 , 43[": 1}
    with pytest.raises(AttrTypeError):
        discretize.bin_equal_width(companies, "string", 4)


def test_equal_frequency(companies):
    df = discretize.bin_equal_frequency(companies, "number")
    assert labels(df, "number_categorical") == {"[-17 , 4[": 4, "[4 , 9[": 4, "[9 , 15[": 4, "[15 , 42[": 4}


def test_custom_ranges(companies):
    once = discretize.bin_custom(companies, "number", [-17, -2, 13, 28, 43])
    assert labels(once, "number_categorical")["[-2 , 13["] == 9
    twice = discretize.bin_custom(once, "number", [-17, 4, 9, 15, 42], exclude_right=False)
    found = labels(twice, "number_categorical_1")
    # The lowest edge itself belongs to no interval that is open on the left.
    assert found == {None: 1, "]-17 , 4]": 3, "]4 , 9]": 5, "]9 , 15]": 3, "]15 , 42]": 4}
    for bad in ([1], [1, 1], [2, 1]):
        with pytest.raises(InvalidValueError):
            discretize.bin_custom(companies, "number", bad)


def test_unit_values_use_tenths(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(100)], "v double")
    edges = discretize.fit_equal_frequency(df, "v")["edges"]
    assert edges[0] == 0.0 and edges[-1] == 1.0 and all(round(e, 1) == e for e in edges)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), min_size=2, max_size=60))
def test_every_value_has_a_bin(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "v int")
    assert discretize.bin_equal_width(df, "v", 5).where("v_categorical IS NULL").count() == 0
    assert discretize.bin_equal_frequency(df, "v").where("v_categorical IS NULL").count() == 0


@pytest.mark.parametrize("leaf_rows", [1, 10, 1_000_000])
@pytest.mark.parametrize("kind", ["spread", "hot", "constant", "huge"])
def test_order_statistics(spark, monkeypatch, leaf_rows, kind):
    monkeypatch.setattr(ordering, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(ordering, "ACCURACY", 50)
    rand = random.Random(7)
    numbers = {
        "spread": [rand.gauss(0, 1e6) for _ in range(1500)],
        "hot": [5.0 if rand.random() < 0.4 else rand.random() * 10 for _ in range(1500)],
        "constant": [3.0] * 500,
        "huge": [float(2 ** 60 + rand.randrange(3) * 256) for _ in range(300)] + [1e300, -1e300],
    }[kind]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,), (float("nan"),)], "v double")
    ranks = sorted({0, 1, len(numbers) // 3, len(numbers) // 2, len(numbers) - 1})
    total, found = ordering.order_statistics(df, "v", lambda n: ranks)
    assert total == len(numbers)
    assert found == {r: sorted(numbers)[r] for r in ranks}


def test_neighbours_across_ranges(spark):
    keys = list(range(0, 4000, 3))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, -k) for k in keys], "k int, w int").repartition(16)
    found = {r["k"]: r for r in ordering.with_neighbours(df, "k", ["k", "w"]).collect()}
    assert len(found) == len(keys)
    assert all(r["next_k"] == (k + 3 if k + 3 < 4000 else None) for k, r in found.items())
    assert all(r["prev_w"] == (3 - k if k else None) for k, r in found.items())


@pytest.mark.parametrize("kind", ["smallint", "bigint", "float", "decimal(10,2)"])
def test_every_numeric_type(spark, kind):
    df = spark.createDataFrame([(i * 3,) for i in range(40)] + [(None,)], "v long").select(F.col("v").cast(kind).alias("v"))
    assert discretize.bin_equal_width(df, "v", 4).where("v_categorical IS NULL").count() == 1
    assert discretize.bin_equal_frequency(df, "v").where("v_categorical IS NULL").count() == 1
    assert discretize.bin_custom(df, "v", [0, 30, 300]).where("v_categorical IS NULL").count() == 1
    assert impute.fill_median(df, "v").dtypes == df.dtypes and impute.fill_mean(df, "v").where("v IS NULL").count() == 0
    assert round(encode.zscore_normalize(df, "v").agg(F.avg("v")).first()[0], 6) == 0.5
    assert rows.replace_outliers(df, "v", True, "100.5", 7).agg(F.max("v")).first()[0] == 99
    assert profile.histogram(df, "v", 4).agg(F.sum("frequency")).first()[0] == 40
    assert profile.histogram(df, "v", 4, "greedy").agg(F.sum("frequency")).first()[0] == 40
