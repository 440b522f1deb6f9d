import csv as python_csv
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewash.plans import history as h
from tablewash.plans import statements as sql
from tablewash.plans.recipe import Step
from tablewash.sources import archive, csv, dump
from tablewash.sources.dataset import Dataset
from tablewash.sources.files import read_file
from tablewash.types import (ConversionError, DumpInconsistencyError, EmptyFileError, InvalidFileExtensionError,
                             InvalidValueError, NoTablesInDumpError)

# The uploaded files.
DEPARTMENTS = """dept_no,dept_name
d001,Marketing
d002,Finance
d003,Human Resources
d004,Production
d005,Development
d006,Quality Management
d007,Sales
d008,Research
d009,Customer Service
"""
DUMP = """CREATE TABLE abc (
    userid\t  INT,
    email        VARCHAR(255) NOT NULL,
    register_date VARCHAR(255)   NOT NULL,

    PRIMARY KEY(userid)
);

INSERT INTO abc VALUES(1, 'test', '01/01/2018');
INSERT INTO abc VALUES(2, 'Luuk', '15/01/2018');
INSERT INTO abc VALUES(3, 'Hoi', '20/01/2018');
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_raw_csv(spark, tmp_path):
    df = read_file(spark, write(tmp_path, "departments.csv", DEPARTMENTS))["departments"]
    assert df.dtypes == [("dept_no", "string"), ("dept_name", "string")]
    assert rows(df)[0] == ("d001", "Marketing") and df.count() == 9
    path = write(tmp_path, "odd.csv", ' a b ,"c"\n\\N,\n"x, y"\n'.replace('"x, y"', '"x,y"'))
    df = csv.read_csv_raw(spark, path)
    assert df.columns == ["a_b", '"c"'] and rows(df) == [(None, ""), ('"x', 'y"')]
    assert csv.read_csv_raw(spark, path, header=False).columns == ["column_0", "column_1"]
    assert csv.read_csv_raw(spark, path, header=False).count() == 3
    for bad in ("a,b\n1\n", "a,b\n1,2,3\n"):
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            csv.read_csv_raw(spark, write(tmp_path, "bad.csv", bad)).collect()


def test_typed_csv(spark, tmp_path):
    path = write(tmp_path, "typed.csv", "n,x,day,other,at,t\n1,1.5,2020-01-02,25/12/2020,2020-01-02 03:04:05,a\n"
                                        "2,,2020-01-03,01/12/2020,2020-01-03,b\n")
    df = csv.read_csv_typed(spark, path)
    assert dict(df.dtypes) == {"n": "int", "x": "double", "day": "date", "other": "date", "at": "timestamp_ntz",
                               "t": "string"}
    assert str(df.first()["other"]) == "2020-12-25"
    assert csv.read_csv_typed(spark, path, header=False).columns[0] == "column_0"


def test_written_csv(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', 1), ("a;b", None), ("", 2)], "v string, n int").coalesce(1)
    csv.write_csv(df, str(tmp_path / "out"), delimiter=";", quotechar='"', null="none")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == 'v;n\n"say ""hi""";1\n"a;b";none\n;2\n'
    for bad in ({"delimiter": ";;"}, {"quotechar": ""}, {"null": "x" * 11}):
        with pytest.raises(InvalidValueError):
            csv.write_csv(df, str(tmp_path / "bad"), **bad)


def test_archive(spark, tmp_path):
    path = tmp_path / "test.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("test1.csv", "Col 1,Col_2,Col_3,Col_4\n2,3,4,5\n,\\N,x,y\n")
        archive.writestr("test2.csv", "Col_1,Col_2\n100,97\n")
        archive.writestr("notes.txt", "no table")
        archive.writestr("folder/test3.csv", "a\n1\n")
        archive.writestr("wide.csv", "a\n1,2\n")
    tables = read_file(spark, str(path))
    assert sorted(tables) == ["test1", "test2", "wide"]
    assert rows(tables["test1"].where("Col_2 = '3'")) == [("2", "3", "4", "5")]
    assert rows(tables["test1"])[1] == ("", None, "x", "y")
    with pytest.raises(Exception, match="has not 1 columns"):
        tables["wide"].collect()


def test_archives_are_read_member_by_member(spark, tmp_path, monkeypatch):
    """Many archives, packed members of several batches, and no archive read as a whole."""
    monkeypatch.setattr(archive, "LINES_PER_BATCH", 50)
    want = []
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w", zipfile.ZIP_DEFLATED) as packed:
            rows_here = [(str(n), str(i), "\u00e9" * (i % 3)) for i in range(120)]
            packed.writestr("t.csv", "a,b,c\r\n" + "".join(",".join(r) + "\r\n" for r in rows_here))
            packed.writestr("other.csv", "x\n1\n")
            want += rows_here
    members = archive.csv_members(spark, f"{tmp_path}/*.zip")
    assert [m["member"] for m in members] == ["other.csv", "t.csv"] * 3
    table = archive.read_csv_members(spark, [m for m in members if m["member"] == "t.csv"])
    assert table.rdd.getNumPartitions() == 3 and sorted(rows(table)) == sorted(want)
    assert "content" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted(archive.read_csv_archive(spark, f"{tmp_path}/*.zip")) == [
        "other", "other_1", "other_2", "t", "t_1", "t_2"]
    with pytest.raises(ValueError):
        archive.read_csv_members(spark, members)


def test_dump(spark, tmp_path):
    df = read_file(spark, write(tmp_path, "test.dump", DUMP))["abc"]
    assert df.dtypes == [("userid", "int"), ("email", "string"), ("register_date", "string")]
    assert sorted(rows(df)) == [(1, "test", "01/01/2018"), (2, "Luuk", "15/01/2018"), (3, "Hoi", "20/01/2018")]


def test_dump_details(spark, tmp_path):
    text = ("DROP TABLE IF EXISTS x; create table \"x\" (a NUMERIC(10,2), b TEXT, c timestamp, CHECK (a > 0));"
            "INSERT INTO x (b, a) VALUES ('it''s (a), b', 1.5), (NULL, -2),\n('', null);"
            "insert into \"x\" values (3, 'plain', '2020-01-02 03:04:05');"
            "create table y (d int); INSERT INTO other VALUES (1)")
    tables = read_file(spark, write(tmp_path, "d.sql", text))
    assert sorted(tables) == ["x", "y"] and tables["y"].count() == 0
    found = sorted(((None if r["a"] is None else float(r["a"])), r["b"], str(r["c"])) for r in tables["x"].collect()
                   if r["a"] is not None)
    assert found == [(-2.0, None, "None"), (1.5, "it's (a), b", "None"), (3.0, "plain", "2020-01-02 03:04:05")]
    assert rows(tables["x"].where("a IS NULL")) == [(None, "", None)]
    with pytest.raises(NoTablesInDumpError):
        read_file(spark, write(tmp_path, "none.sql", "INSERT INTO x VALUES (1);"))
    with pytest.raises(DumpInconsistencyError):
        read_file(spark, write(tmp_path, "odd.sql", "CREATE TABLE x;"))
    semicolon = read_file(spark, write(tmp_path, "cut.sql", "CREATE TABLE x (a TEXT); INSERT INTO x VALUES ('a;b');"))
    assert rows(semicolon["x"]) == [("a;b",)]
    with pytest.raises(DumpInconsistencyError):
        read_file(spark, write(tmp_path, "open.sql", "CREATE TABLE x (a TEXT); INSERT INTO x VALUES ('a;b);"))
    wide = read_file(spark, write(tmp_path, "wide.sql", "CREATE TABLE x (a TEXT); INSERT INTO x VALUES ('a', 'b');"))
    with pytest.raises(Exception, match="cannot read row"):
        wide["x"].collect()


def test_dump_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b's", 1.5, True), (2, None, float("nan"), None), (3, "x" * 50_000, -1e20, False)],
                               "n int, `t x` string, f double, b boolean")
    df = df.withColumn("d", F.to_date(F.lit("2020-01-02")))
    folder = str(tmp_path / "out")
    dump.write_sql_dump(df, folder, "t")
    back = dump.read_sql_dump(spark, f"{folder}/*")["t"]
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_file_errors(spark, tmp_path):
    with pytest.raises(EmptyFileError):
        read_file(spark, write(tmp_path, "empty.csv", ""))
    with pytest.raises(InvalidFileExtensionError):
        read_file(spark, write(tmp_path, "data.xls", "x"))
    with pytest.raises(InvalidValueError):
        read_file(spark, write(tmp_path, "a b.csv", "x\n1\n"))


def test_dataset(spark, companies, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    assert data.tables() == [] and data.history().count() == 0
    assert data.add("firms", companies) == "firms" and data.add("firms", companies) == "firms_1"
    assert data.ingest(write(tmp_path, "departments.csv", DEPARTMENTS)) == ["departments"]
    data.apply("firms", Step(h.OUTLIERS, "number", {"larger": True, "value": 20, "replacement": 20}))
    data.apply("firms", Step(h.FILL_VALUE, "fpoint", {"value": 1}))
    assert data.table("firms").agg(F.max("number"), F.sum("fpoint")).first() == (20, 16.0)
    assert data.original("firms").agg(F.max("number")).first()[0] == 41
    with pytest.raises(ConversionError):
        data.apply("firms", Step(h.CONVERT, "string", {"to_type": "INTEGER"}))
    assert data.undo("firms").where("fpoint IS NOT NULL").count() == 0
    assert data.history().count() == 1
    copy = data.copy("firms", "firms")
    assert copy == "firms_2" and data.table(copy).agg(F.max("number")).first()[0] == 20
    data.drop("firms_1")
    assert data.tables() == ["departments", "firms", "firms_2"]
    with pytest.raises(InvalidValueError):
        data.table("firms_1")
    with pytest.raises(InvalidValueError):
        data.undo(copy)


def test_dataset_snapshots_and_undo(spark, companies, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    data.add("t", companies)
    for i in range(7):
        data.apply("t", Step(h.CUSTOM_RANGES, "number", {"edges": [0, 10 + i]}))
    kinds = [r["transformation_type"] for r in data.history().collect()]
    # Three heavy steps reach the cost of a snapshot; the two newest stay.
    assert kinds == [4, 4, 4, -1, 4, 4, 4, -1, 4]
    assert len(data.table("t").columns) == 14
    for width in (13, 12, 11, 10):
        assert len(data.undo("t").columns) == width
    assert [r["transformation_type"] for r in data.history().collect()] == [4, 4, 4, -1]
    assert data.is_undo_enabled("t") and len(data.undo("t").columns) == 9


def test_dataset_scripts_and_dedup(spark, companies, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    data.add("t", companies.select(F.monotonically_increasing_id().alias("id"), "string", "number"))
    with pytest.raises(Exception):
        data.execute([sql.Delete("t", "number > 0"), sql.Update("t", {"number": "nonsense"})])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        data.execute([sql.Delete("t", "number > 0"), sql.Update("t", {"number": "CAST(string AS INT)"})])
    assert data.table("t").count() == 16 and data.history().count() == 0
    result = data.execute([sql.Delete("t", "number < 0"), sql.Select("SELECT count(*) AS n FROM t")])
    assert rows(result) == [(14,)] and data.table("t").count() == 14
    data.execute([sql.Insert("t", [(100, "Microsofd", 8), (101, "Sonny", 9)])])
    kept = data.deduplicate("t", "id", ["number"], ignore=["number"], threshold=0.8)
    assert kept.count() == 14 and data.table("t").count() == 14
    assert [r["transformation_type"] for r in data.history().collect()] == [16, 16, 18]
    assert data.undo("t").count() == 16


def test_exports(spark, companies, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    data.add("t", companies.select("string", "number"))
    data.apply("t", Step(h.DELETE_ROWS, "", {"clauses": ["number", "<", 0]}))
    data.export_csv(str(tmp_path / "csv"), original=True)
    assert csv.read_csv_raw(spark, str(tmp_path / "csv/edited/t")).count() == 14
    assert csv.read_csv_raw(spark, str(tmp_path / "csv/original/t")).count() == 16
    data.export_dump(str(tmp_path / "dump"))
    assert dump.read_sql_dump(spark, f"{tmp_path}/dump/t/*")["t"].count() == 14


def test_raw_csv_fails_on_uneven_rows_whatever_is_read(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    df = csv.read_csv_raw(spark, str(path))
    for look in (lambda: df.collect(), lambda: df.select("b").collect(), lambda: df.count()):
        with pytest.raises(Exception, match="MALFORMED"):
            look()


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "300")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def odd_text(rng, signs, size):
    return "".join(rng.choice(signs) for _ in range(rng.randrange(size)))


def test_foreign_dump_in_small_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    signs = list("ab;()',\"\n\r\\ ") + ["--", "/*", "*/", "''", "VALUES (", ");", "INSERT INTO t VALUES (9, 'x');", "é"]
    want, parts = [], ["-- it's a dump; of (t\n/* ; ' ( */ SET x = 'y;';\nCREATE TABLE t (n INT, \"b\" TEXT, c TEXT);\n"]
    number = 0
    for statement in range(12):
        named = statement % 3 == 1
        rows_here = []
        for _ in range(rng.choice([1, 3, 25])):
            b, c = (None if rng.random() < 0.1 else odd_text(rng, signs, 40) for _ in range(2))
            if number % 40 == 7:
                b = odd_text(rng, signs, 1500)  # over several ranges
            want.append((number, b, c))
            quoted = ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in (b, c)]
            if c is not None and number % 5 == 2:
                quoted[1] = "E'" + c.replace("\\", "\\\\").replace("'", rng.choice(["''", "\\'"])).replace("\n", "\\n") + "'"
            cells = [quoted[1], str(number), quoted[0]] if named else [str(number), *quoted]
            rows_here.append("(" + " , ".join(cells) + ")")
            number += 1
        parts.append('INSERT INTO "t"' + (' (c, n, "b")' if named else "") + " VALUES " + ",\n  ".join(rows_here)
                     + rng.choice(["", " ON CONFLICT DO NOTHING", " -- it's done\n"]) + ";\n")
        parts.append(rng.choice(["", "-- don't; (\n", "/* it's ( */", "INSERT INTO other VALUES ('t;', (1));", "SELECT ';';"]))
    path = write(tmp_path, "foreign.sql", "")
    with open(path, "w", newline="") as file:
        file.write("".join(parts))
    table = read_file(spark, path)["t"]
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert sorted(rows(table)) == sorted(want)


def test_typed_csv_in_small_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    signs = list('ab,";\n') + ["\n\n", '"",', ' "', "é", "\r\n"]
    want = [(n, rng.randrange(1000) / 8, odd_text(rng, signs, 1200 if n % 30 == 3 else 30) + "x", n % 3 == 0) for n in range(200)]
    for number, ending in enumerate(("\n", "\r\n")):
        path = str(tmp_path / f"texts{number}.csv")
        with open(path, "w", newline="") as file:
            out = python_csv.writer(file, lineterminator=ending)
            out.writerow(["n", "x", "note", "t"])
            out.writerows([(n, x, note, str(t).lower()) for n, x, note, t in want])
        df = csv.read_csv_typed(spark, path)
        assert dict(df.dtypes) == {"n": "int", "x": "double", "note": "string", "t": "boolean"}
        assert sorted(rows(df)) == want
        assert csv.read_csv_typed(spark, path, header=False).count() == 201


def test_csv_line_ends():
    for line, ends in (("a,b", (False, True)), ('"a', (True, False)), ('a,"b', (True, False)), ('"a""b",c', (False, False)),
                       ('a"b,c', (False, False)), ('"a","b', (True, True)), ('""', (False, True)), ("", (False, True)),
                       ('"a"x"b,"', (True, True)), ('x",y', (False, False)), (',"""', (True, False))):
        assert (csv.line_end(line, False), csv.line_end(line, True)) == ends, line


def test_types_of_columns(spark, tmp_path):
    lines = ["i,l,d,f,e,b,day,at,when,mix,none,q", "1,5000000000,12345678901234567890,1.5,1e3,TRUE,1/2/2020,2020-01-02,"
             "2020-01-02T00:00:00Z,1,,x", "-2,3,7,.5,-2,false,12/31/2020,2020-01-03 04:05:06,2020-01-03T00:00:00Z,x,,",
             "+3,4,8,7,NaN,True,2/28/2021,NULL,2020-01-04T00:00:00Z,2020-01-01,,1"]
    df = csv.read_csv_typed(spark, write(tmp_path, "kinds.csv", "\n".join(lines)))
    assert dict(df.dtypes) == {"i": "int", "l": "bigint", "d": "decimal(20,0)", "f": "double", "e": "double", "b": "boolean",
                               "day": "date", "at": "timestamp_ntz", "when": "date", "mix": "string", "none": "string",
                               "q": "string"}
    assert [r["i"] for r in df.collect()] == [1, -2, 3] and df.where("at is null").count() == 1
    with pytest.raises(InvalidValueError, match="does not end"):
        csv.read_csv_typed(spark, write(tmp_path, "open.csv", 'a,b\n1,"x\n2,y\n'))
