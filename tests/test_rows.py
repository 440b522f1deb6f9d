import pytest
from pyspark.sql import functions as F

from tablewash.operators import impute, replace, rows
from tablewash.types import AttrTypeError, InvalidValueError


def by_name(df, column):
    return {row["string"]: row[column] for row in df.collect()}


def test_delete_rows(companies, statistics):
    assert rows.delete_rows_where(companies, ["string", "=", "C-Corp"]).count() == 15
    assert rows.delete_rows_where(companies, ["number", ">", "10", "AND", "number", "<", 20]).count() == 13
    either = ["number", "<", 0, "OR", "number", ">", 20, "AND", "string", "!=", "Apple"]
    assert rows.delete_rows_where(companies, either).count() == 12
    assert rows.delete_rows_where(statistics, ["string", "=", '"null"']).count() == 4
    assert rows.delete_rows_where(statistics, ["string", "!=", None]).count() == 2
    # Rows for which the predicate is unknown stay.
    assert rows.delete_rows_where(statistics, ["string", "!=", "haha"]).count() == 4
    for bad in ([], ["number", "="], ["number", "=", 1, "XOR", "number", "=", 2], ["number", "~", 1],
                ["number", "=", "abc"], ["unknown", "=", 1]):
        with pytest.raises(InvalidValueError):
            rows.delete_rows_where(companies, bad)


def test_equality_operators(companies):
    assert rows.select_where(companies).count() == 16
    assert rows.delete_where(companies).count() == 0
    assert rows.select_where(companies, {"number": 8, "string": "Toshiba"}).count() == 1
    assert rows.delete_where(companies, {"number": 8}).count() == 14
    updated = rows.update_where(companies, {"number": 8}, {"string": "Eight", "fpoint": 1})
    assert [r["fpoint"] for r in updated.where("string = 'Eight'").collect()] == [1.0, 1.0]
    with pytest.raises(InvalidValueError):
        rows.update_where(companies, {}, {"number": 1})
    more = rows.insert_row(companies, {"string": "New", "number": "5"})
    assert more.schema == companies.schema and more.where("string = 'New' AND number = 5").count() == 1
    with pytest.raises(InvalidValueError):
        rows.insert_row(companies, {"unknown": 1})


def test_outliers(companies):
    high = by_name(rows.replace_outliers(companies, "number", True, 20, 0), "number")
    assert [high[n] for n in ("Apple", "Nintendo", "Elevate ltd", "Nokia")] == [0, 0, 0, 18]
    low = by_name(rows.replace_outliers(companies, "number", False, 1, -1), "number")
    assert [low[n] for n in ("Dummy", "LG Electronics", "C-Corp")] == [-1, -1, 1]
    with pytest.raises(AttrTypeError):
        rows.replace_outliers(companies, "string", True, 1, 1)


def test_find_and_replace(companies):
    def names(df):
        return {row["string"] for row in df.collect()}

    assert "Replacement" in names(replace.find_and_replace(companies, "string", "C-Corp", "Replacement"))
    whole = names(replace.find_and_replace(companies, "string", "Sam", "Foobar", exact=False))
    assert "Foobar" in whole and "Samsung" not in whole
    part = names(replace.find_and_replace(companies, "string", "To", "Waka", exact=False, replace_all=False))
    assert "Wakashiba" in part
    assert names(replace.find_and_replace(companies, "string", "Apple", "x", True, False)) == names(companies)
    assert by_name(replace.find_and_replace(companies, "number", "41", "42"), "number")["Elevate ltd"] == 42
    with pytest.raises(InvalidValueError):
        replace.find_and_replace(companies, "string", "C-", "x", exact=False)
    with pytest.raises(AttrTypeError):
        replace.find_and_replace(companies, "number", "1", "2", exact=False)


def test_regex(companies, spark):
    assert replace.regex_find_and_replace(companies, "string", "Nin.*", "SEGA").where("string = 'SEGA'").count() == 1
    assert replace.regex_find_and_replace(companies, "string", "nin.*", "SEGA", True).where("string = 'SEGA'").count() == 0
    with pytest.raises(InvalidValueError):
        replace.regex_find_and_replace(companies, "string", "(", "x")
    with pytest.raises(AttrTypeError):
        replace.regex_find_and_replace(companies, "number", "1", "x")
    df = spark.createDataFrame([("a1",), ("b c",), ("bc",)], "v string")

    def changed(regex):
        return [r["v"] for r in replace.regex_find_and_replace(df, "v", regex, "X").collect()]

    assert changed("[[:digit:]]") == ["X", "b c", "bc"]
    assert changed(r"\mc\M") == ["a1", "X", "bc"]
    assert changed("[^[:alnum:]]") == ["a1", "X", "bc"]


def test_filling(companies):
    gaps = companies.withColumn("number", F.when(F.col("number") <= 40, F.col("number")))
    assert by_name(impute.fill_mean(gaps, "number"), "number")["Elevate ltd"] == 8
    assert by_name(impute.fill_median(gaps, "number"), "number")["Elevate ltd"] == 8
    assert by_name(impute.fill_value(gaps, "number", 1000), "number")["Elevate ltd"] == 1000
    assert round(impute.fit_mean(gaps, "number")["value"], 4) == 7.8667
    assert impute.fill_median(companies, "fpoint").where("fpoint IS NULL").count() == 16
    for fill in (impute.fill_mean, impute.fill_median):
        with pytest.raises(AttrTypeError):
            fill(companies, "string")


def test_median_of_integers_rounds_half_up(spark):
    df = spark.createDataFrame([(8,), (9,), (None,)], "v int")
    assert [r["v"] for r in impute.fill_median(df, "v").collect()] == [8, 9, 9]
    df = spark.createDataFrame([(-8,), (-9,), (None,)], "v int")
    assert [r["v"] for r in impute.fill_median(df, "v").collect()] == [-8, -9, -9]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert [r["v"] for r in impute.fill_mean(df, "v").collect()] == [1.0, 3.0, 2.0, 2.0]
    assert [r["v"] for r in impute.fill_median(df, "v").collect()] == [1.0, 3.0, 2.0, 2.0]
