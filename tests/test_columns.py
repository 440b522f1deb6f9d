import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewash.naming import check_table_name, free_table_name, unique_name
from tablewash.operators import columns, dates
from tablewash.types import AttrTypeError, ConversionError, InvalidValueError, column_types


def values(df, column):
    return [row[column] for row in df.collect()]


def test_drop_and_rename(companies):
    assert "garbage" not in columns.drop_column(companies, "garbage").columns
    assert columns.drop_column(companies, "unknown").columns == companies.columns
    assert columns.rename_column(companies, "string", "company").columns[0] == "company"
    assert columns.rename_column(companies, "string", "number").columns[0] == "number_1"


def test_unique_names():
    assert unique_name(["a", "b"], "c") == "c"
    assert unique_name(["a"], "a") == "a_1"
    assert unique_name(["a_3"], "a") == "a_4"
    assert unique_name(["x_1"], "1") == "1"
    assert free_table_name(["t", "t_1"], "t") == "t_2"
    assert check_table_name("a_1") == "a_1"
    with pytest.raises(InvalidValueError):
        check_table_name("a b")


def test_text_to_date_and_back(companies):
    df = columns.convert(companies, "date_string", "DATE", "DD/MM/YYYY")
    assert dict(df.dtypes)["date_string"] == "date"
    assert values(df, "date_string")[0] == dt.date(1997, 8, 8)
    back = columns.convert(df, "date_string", "VARCHAR(n)", length=10)
    assert values(back, "date_string")[0] == "1997-08-08"
    assert column_types(back)["date_string"] == "VARCHAR(10)"


def test_text_to_timestamp_without_time(companies):
    df = columns.convert(companies, "date_string", "TIMESTAMP", "DD/MM/YYYY TIME")
    assert values(df, "date_string")[3] == dt.datetime(1865, 5, 12)


def test_text_to_time(companies):
    df = companies.withColumn("date_string", F.lit("08:42 PM"))
    assert set(values(columns.convert(df, "date_string", "TIME", "HH12:MI AM/PM"), "date_string")) == {"20:42:00"}


def test_strict_conversion_names_the_failures(spark):
    df = spark.createDataFrame([("1",), ("x",), ("2.5",), ("",), (None,)], "v string")
    with pytest.raises(ConversionError, match="2 values"):
        columns.convert(df, "v", "INTEGER")
    with pytest.raises(Exception, match="cannot convert value"):
        columns.convert(df, "v", "INTEGER", validate=False).collect()
    with pytest.raises(ConversionError, match="length 2"):
        columns.convert(df, "v", "CHAR(n)", length=2)
    good = df.where("v IS NULL OR v IN ('1', '')")
    assert values(columns.convert(good, "v", "INTEGER"), "v") == [1, None, None]
    assert values(columns.convert(good, "v", "INTEGER", validate=False), "v") == [1, None, None]
    assert values(columns.convert(good, "v", "VARCHAR(n)", length=1), "v") == ["1", "", None]


def test_forced_conversion(spark):
    df = spark.createDataFrame([("1",), ("x",), ("1.5e10",), ("-.5",), ("1d",), ("",), (None,)], "v string")
    assert values(columns.force_convert(df, "v", "INTEGER"), "v") == [1, None, None, None, None, None, None]
    assert values(columns.force_convert(df, "v", "FLOAT"), "v") == [1.0, None, 1.5e10, -0.5, None, None, None]
    kept = columns.force_convert(df, "v", "INTEGER", mode="DELETE_ROW")
    assert values(kept, "v") == [1, None]
    shaped = columns.force_convert(df, "v", "FLOAT", compat_regex=True)
    assert values(shaped, "v") == [1.0, None, None, None, None, None, None]
    assert values(columns.force_convert(df, "v", "VARCHAR(n)", length=2), "v") == ["1", "x", None, None, "1d", "", None]
    with pytest.raises(InvalidValueError):
        columns.force_convert(df, "v", "INTEGER", mode="OTHER")


def test_numbers_to_text_and_integer(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (None,)], "v double")
    assert values(columns.convert(df, "v", "INTEGER"), "v") == [2, 4, -2, None]
    df = spark.createDataFrame([(901.0,), (0.1,), (12345678.5,), (1e20,), (1.5e-7,), (0.0005,), (1e7,)], "v double")
    assert values(columns.convert(df, "v", "VARCHAR(255)"), "v") == [
        "901", "0.1", "12345678.5", "1e+20", "1.5e-07", "0.0005", "10000000"]
    with pytest.raises(ConversionError):
        columns.convert(df, "v", "INTEGER")


def test_options_and_gates(companies):
    assert "DATE" in columns.conversion_options(companies, "string")
    assert columns.conversion_options(companies, "number") == ["FLOAT", "VARCHAR(255)", "VARCHAR(n)", "CHAR(n)"]
    assert dates.extraction_options(companies, "date_time") == dates.PARTS
    assert dates.extraction_options(companies, "number") == []
    with pytest.raises(InvalidValueError):
        columns.convert(companies, "number", "DATE", "DD/MM/YYYY")
    with pytest.raises(InvalidValueError):
        columns.convert(companies, "string", "DATE", "YYYY")
    with pytest.raises(AttrTypeError):
        dates.extract_date_part(companies, "string", "YEAR")
    with pytest.raises(InvalidValueError):
        dates.extract_date_part(companies, "date_time", "DECADE")


@pytest.mark.parametrize("part, nintendo, unknown", [
    ("YEAR", "1989", None), ("MONTH + YEAR", "September 1989", ""), ("MONTH", "September", None),
    ("DAY OF THE WEEK", "Saturday", None)])
def test_date_parts(companies, part, nintendo, unknown):
    df = columns.convert(companies, "date_string", "DATE", "DD/MM/YYYY")
    df = df.withColumn("date_string", F.when(F.col("string") != "Apple", F.col("date_string")))
    df = dates.extract_date_part(df, "date_string", part)
    found = {row["string"]: row["date_string_part"] for row in df.collect()}
    assert found["Nintendo"] == nintendo
    assert found["Apple"] == unknown
    assert dates.extract_date_part(df, "date_string", part).columns[-1] == "date_string_part_1"
