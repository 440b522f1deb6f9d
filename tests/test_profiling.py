import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewash.functions import pages
from tablewash.operators import profile
from tablewash.types import column_types


def one(df):
    return df.first()[0]


def test_statistics(statistics):
    assert one(profile.row_count(statistics)) == 6
    assert one(profile.column_max(statistics, "number")) == 4
    assert one(profile.column_min(statistics, "number")) == 1
    assert one(profile.column_avg(statistics, "number")) == 14 / 6
    assert one(profile.column_avg(statistics, "string")) == "N/A"
    assert [one(profile.null_frequency(statistics, c)) for c in statistics.columns] == [2, 0, 1]
    assert [one(profile.most_frequent_value(statistics, c)) for c in statistics.columns] == ["haha", 2, "01/01/2001"]
    assert one(profile.column_max(statistics.limit(0), "number")) is None
    table = {r["column"]: r for r in profile.column_profile(statistics).collect()}
    assert table["number"]["min"] == "1" and table["string"]["max"] == "N/A" and table["string"]["null_count"] == 2
    assert table["string"]["most_frequent"] == "haha"
    assert column_types(statistics) == {"string": "VARCHAR", "number": "INTEGER", "date_time": "VARCHAR"}


def test_frequency_chart(spark):
    df = spark.createDataFrame([("a",)] * 70 + [("b",)] * 15 + [(None,)] * 6 + [("c",)] * 5 + [("d",)] * 4, "v string")
    found = [(r["label"], r["frequency"]) for r in profile.frequency_chart(df, "v").collect()]
    assert found == [("a", 70), ("b", 15), (None, 6), ("c", 5), ("other", 4)]
    own = spark.createDataFrame([("other",)] * 50 + [(str(i),) for i in range(50)], "v string")
    assert [tuple(r) for r in profile.frequency_chart(own, "v").collect()] == [
        ("other", 50, False), ("other", 50, True)]


def test_histogram(viewer, spark):
    bins = profile.histogram(viewer, "number").collect()
    assert [b["frequency"] for b in bins] == [40, 0, 0, 10, 0, 10, 0, 0, 0, 10]
    assert bins[0]["label"] == "(1, 900)" and bins[-1]["label"] == "(8101, 9000)"
    assert profile.histogram(viewer, "string").count() == 0
    same = spark.createDataFrame([(3,), (3,), (None,)], "v int")
    assert [b["frequency"] for b in profile.histogram(same, "v", 4).collect()][0] == 2
    assert profile.histogram(same.where("v IS NULL"), "v").count() == 0


def walk(values, bins):
    """One bin further per value at most."""
    values = sorted(values)
    width = (max(values) - min(values)) / bins
    edge, counts = min(values) + width, [0]
    for v in values:
        if v >= edge:
            edge += width
            counts.append(0)
        counts[-1] += 1
    return counts


def test_greedy_histogram(viewer, spark):
    found = [r["frequency"] for r in profile.histogram(viewer, "number", compat="greedy").collect()]
    assert found == walk([r["number"] for r in viewer.collect()], 10)
    rand = random.Random(5)
    for size, bins in ((1, 3), (7, 10), (200, 10), (300, 4)):
        values = [rand.choice([0, 1, 2, 50, 51, rand.randrange(1000)]) for _ in range(size)] + [-1]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert [r["frequency"] for r in profile.histogram(df, "v", bins, "greedy").collect()] == walk(values, bins)


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "NEAR_ROWS", 0)
    rand = random.Random(4)
    rows = [(n, rand.choice([None, rand.randrange(40)])) for n in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(6)
    for ascending in (True, False):
        want = sorted(rows, key=lambda r: ((r[1] is None) == ascending, (r[1] or 0) * (1 if ascending else -1), r[0]))
        for offset, limit in ((0, 10), (123, 50), (490, 50), (500, 5)):
            got = profile.page(df, offset, limit, "v", ascending, ["id"])
            assert [tuple(r) for r in got.collect()] == want[offset:offset + limit] and got.columns == df.columns


def sorted_rows(rows, places, ascending):
    """By columns; NULL above all values, NaN above all other numbers, text by its bytes."""
    def key(value):
        if value is None:
            return (3, 0)
        if isinstance(value, float) and value != value:
            return (2, 0)
        return (1, value.encode() if isinstance(value, str) else value)

    for place, up in reversed(list(zip(places, ascending))):
        rows = sorted(rows, key=lambda r: key(r[place]), reverse=not up)
    return rows


def test_deep_pages_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(pages, "NEAR_ROWS", 20)
    rand = random.Random(8)
    texts = ["", "a", "a\0", "Customer#0001", "Customer#00010", "Customer#0002", "ä", "𝒳y", "abcdef", "abcdefg", "abcdef" * 4,
             "abcdef" * 4 + "x"]
    rows = [(n, rand.choice([None, *texts]), rand.choice([None, True, False]),
             rand.choice([None, float("nan"), float("inf"), -0.5, 1e300, -2.0, 0.0]),
             rand.choice([None, 2 ** 62, 2 ** 62 + 1, -2 ** 62, 5, -(2 ** 63)]),
             rand.choice([None, dt.date(1960, 2, 3), dt.date(2020, 1, 1)]),
             rand.choice([None, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2020, 1, 1, 0, 0, 0, 1)]),
             rand.choice([None, Decimal("1.10"), Decimal("-7.00")])) for n in range(160)]
    df = spark.createDataFrame(rows, "id int, s string, b boolean, f double, l long, d date, t timestamp_ntz, "
                                     "c decimal(10,2)").repartition(5)
    names = df.columns
    for on in ("s", "b", "f", "l", "d", "t", "c"):
        for ascending in (True, False):
            want = sorted_rows(rows, [names.index(on), 0], [ascending, True])
            for offset, limit in ((60, 30),):
                got = profile.page(df, offset, limit, on, ascending, ["id"]).collect()
                assert [r["id"] for r in got] == [r[0] for r in want[offset:offset + limit]], (on, ascending)


def test_deep_pages_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(pages, "NEAR_ROWS", 5)
    df = spark.createDataFrame([("a", n % 3) for n in range(60)] + [("b", 1)] * 50 + [("c", 9)] * 20, "s string, n int")
    for offset, limit, want in ((50, 30, {("a",): 10, ("b",): 20}), (100, 90, {("b",): 10, ("c",): 20})):
        got = profile.page(df, offset, limit, "s").collect()
        assert Counter((r["s"],) for r in got) == want
    seen = [tuple(r) for offset in range(0, 130, 26) for r in profile.page(df, offset, 26, "s").collect()]
    assert [s for s, _ in seen] == ["a"] * 60 + ["b"] * 50 + ["c"] * 20
    assert Counter(seen) == {("a", 0): 20, ("a", 1): 20, ("a", 2): 20, ("b", 1): 50, ("c", 9): 20}


def test_deep_page_writes_no_copy(spark, monkeypatch):
    monkeypatch.setattr(pages, "NEAR_ROWS", 10)
    df = spark.range(50_000).selectExpr("id", "id * 7 % 50000 AS v", "repeat('x', 100) AS wide")
    with monkeypatch.context() as no:
        no.setattr(type(df), "checkpoint", None)
        got = profile.page(df, 30_000, 20, "v")
        assert [r["v"] for r in got.collect()] == list(range(30_000, 30_020))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_deep_unsorted_pages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pages, "NEAR_ROWS", 10)
    spark.range(1000).selectExpr("id", "id % 7 AS _at").repartitionByRange(7, "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    whole = [tuple(r) for r in df.collect()]
    for offset, limit in ((0, 50), (100, 300), (990, 100), (1000, 5), (5, 995)):
        got = profile.page(df, offset, limit)
        assert [tuple(r) for r in got.collect()] == whole[offset:offset + limit] and got.columns == df.columns
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_profile_by_sketch(spark, monkeypatch):
    """Columns that a sketch decides, leaves open, or names too many values of; ties, NULL and NaN."""
    rng = random.Random(9)
    rows = [(n, rng.choice("aab"), "x" if n % 2 else "y", rng.choice([None, None, None, "n", "m"]), rng.randrange(200),
             float("nan") if n % 3 else float(n % 5), None, n % 40) for n in range(4000)]
    df = spark.createDataFrame(rows, "k int, a string, tie string, nulls string, some int, f double, none string, even int")
    want = {}
    for place, name in enumerate(df.columns):
        counted = Counter("NaN" if isinstance(r[place], float) and r[place] != r[place] else r[place] for r in rows)
        best = max(counted.values())
        values = [v for v, c in counted.items() if c == best]
        first = min(values, key=lambda v: (v is None, v == "NaN", v if v is not None and v != "NaN" else 0))
        want[name] = (None if first is None else str(first), best)
    for followed in (4000, 64):
        monkeypatch.setattr(profile, "FOLLOWED", followed)
        monkeypatch.setattr(profile, "SKETCH_ERROR", 3.5 / followed)
        got = {r["column"]: (r["most_frequent"], r["most_frequent_count"]) for r in profile.column_profile(df).collect()}
        assert got == want


def test_pages(statistics):
    def names(df):
        return [r["string"] for r in df.collect()]

    assert names(profile.page(statistics, 0, 3, "string")) == ["haha", "haha", "hihi"]
    assert names(profile.page(statistics, 4, 10, "string")) == [None, None]
    assert names(profile.page(statistics, 0, 3, "string", ascending=False)) == [None, None, "hoho"]
    assert profile.page(statistics, 2, 2).count() == 2


def test_json_rows(spark):
    df = spark.createDataFrame([(1, 'q"é\n', 1.5, True, None)], "a int, b string, c double, d boolean, e string")
    df = df.withColumn("f", F.to_date(F.lit("2020-01-02")))
    assert json.loads(one(profile.to_json_rows(df))) == [1, 'q"é\n', 1.5, True, None, "2020-01-02"]


@pytest.mark.parametrize("size", [1, 2])
def test_having(statistics, size):
    found = profile.frequent_values(statistics, "string", F.col("frequency") == size).collect()
    assert len(found) == 2
