import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablewash.plans import history as h
from tablewash.plans import statements as sql
from tablewash.plans.recipe import Step
from tablewash.sources import commits
from tablewash.sources.commits import CommitLog, State
from tablewash.sources.dataset import Dataset
from tablewash.types import InvalidValueError


def fill(value):
    return Step(h.FILL_VALUE, "v", {"value": value})


def two_tables(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    for name in ("a", "b"):
        data.add(name, spark.createDataFrame([(1, None), (2, 5)], "n int, v int"))
    return data


def state_of(data):
    return {name: sorted(map(tuple, data.table(name).collect())) for name in data.tables()}, data.history().count()


def test_script_over_two_tables_is_one_commit(spark, tmp_path):
    data = two_tables(spark, tmp_path)
    before = data.version()
    data.execute("UPDATE a SET v = 7 WHERE n = 1; DELETE FROM b WHERE n = 1; INSERT INTO a SELECT n, v FROM b")
    assert data.version() == before + 1
    assert state_of(data) == ({"a": [(1, 7), (2, 5), (2, 5)], "b": [(2, 5)]}, 2)


@pytest.mark.parametrize("failing", [
    "UPDATE a SET v = 7; UPDATE b SET v = CAST('x' AS INT)", "UPDATE a SET v = 7; DELETE FROM c", "UPDATE a SET v = 7; DROP TABLE b",
    "UPDATE a SET v = 7; SET spark.tests.leak = 1", "DELETE FROM b; CREATE TABLE c AS SELECT 1", "DELETE FROM b; CACHE TABLE a",
    "DELETE FROM b; WITH x AS (SELECT 1) SELECT * FROM nowhere"])
def test_failing_script_changes_neither_table(spark, tmp_path, failing):
    data = two_tables(spark, tmp_path)
    before = state_of(data), data.version()
    with pytest.raises(Exception):
        data.execute(failing)
    assert (state_of(data), data.version()) == before
    assert spark.conf.get("spark.tests.leak", None) is None


def test_failure_between_the_snapshots_of_two_tables(spark, tmp_path, monkeypatch):
    data = two_tables(spark, tmp_path)
    for name in ("a", "b"):
        for _ in range(2):
            data.execute(f"UPDATE {name} SET v = coalesce(v, 0) + 1")
    before = state_of(data)
    written = []

    def write(df, folder, whole=data._write):
        written.append(folder)
        if len(written) == 2:
            raise OSError("disk full")
        return whole(df, folder)

    monkeypatch.setattr(data, "_write", write)
    with pytest.raises(OSError):
        data.execute("UPDATE a SET v = 0; UPDATE b SET v = 0")
    assert len(written) == 2 and state_of(data) == before
    monkeypatch.undo()
    data.execute("UPDATE a SET v = 0; UPDATE b SET v = 0")
    assert state_of(data)[0] == {"a": [(1, 0), (2, 0)], "b": [(1, 0), (2, 0)]}


def test_two_writers_lose_nothing(spark, tmp_path):
    data = two_tables(spark, tmp_path)
    root = data.root

    def work(n):
        mine = Dataset(spark.newSession(), root)
        for step in range(3):
            mine.execute(f"INSERT INTO {'ab'[n % 2]} VALUES ({100 * n + step}, {step})")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    assert sorted(r["n"] for r in data.table("a").collect()) == sorted([1, 2, 0, 1, 2, 200, 201, 202])
    assert sorted(r["n"] for r in data.table("b").collect()) == [1, 2, 100, 101, 102]
    log = [r for r in data.history().collect() if r["transformation_type"] == h.STATEMENTS]
    assert len(log) == 9 and len({r["transformation_id"] for r in log}) == 9
    assert len(os.listdir(f"{root}/log")) == data.version()


def test_overtaken_writers_build_again_only_if_they_must(spark, tmp_path):
    data = two_tables(spark, tmp_path)
    other = Dataset(spark, data.root)
    built = []

    def racing(name, table):
        def build(state):
            if not built:
                other.apply(table, fill(3))
            built.append(state.version)
            return commits.Change({name: commits.TableChange(entries=[(name, "v", h.FILL_VALUE, '{"value": 4}', name)],
                                                             files=[[]])})
        return build

    data._commit(racing("a", "b"))
    assert len(built) == 1 and data.version() == 4
    built.clear()
    data._commit(racing("a", "a"))
    assert len(built) == 2 and built[1] == built[0] + 1
    assert [r["transformation_id"] for r in data.history().collect()] == [1, 2, 3, 4]


def test_files_outlive_their_readers(spark, tmp_path):
    data = two_tables(spark, tmp_path)
    data.execute("INSERT INTO a SELECT n + 10, v FROM b")
    copy = data.copy("a", "c")
    old, copied, version = data.table("a"), data.table(copy), data.version()
    data.undo("a")
    data.drop("a")
    data.drop(copy)
    assert old.count() == 4 and copied.count() == 4
    assert data.tables() == ["b"] and data.table("a", version).count() == 4 and "c" in data.tables(version)
    assert data.sweep(keep=100, older_than=0) == [] and data.sweep(keep=1) == []
    swept = data.sweep(keep=1, older_than=0)
    assert sorted(name.split("/")[0] for name in swept) == ["inserted", "original", "snapshots"]
    assert data.table("b").count() == 2 and data.sweep(keep=1, older_than=0) == []
    with pytest.raises(InvalidValueError):
        data.tables(99)


def test_folded_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FOLDED_EVERY", 3)
    data = two_tables(spark, tmp_path)
    for n in range(5):
        data.apply("a", fill(n))
    names = sorted(os.listdir(f"{data.root}/log"))
    assert [name for name in names if name.endswith(".state")] == [f"{3:020d}.state", f"{6:020d}.state"]
    fresh = Dataset(spark, data.root)
    reads = []
    monkeypatch.setattr(fresh.log, "_commit", lambda v, read=fresh.log._commit: reads.append(v) or read(v))
    assert state_of(fresh) == state_of(data) and min(reads) == 7
    assert vars(fresh.log.state_at(5)) == vars(State.from_json(data.log.state_at(5).to_json()))


def test_names_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: log._put("x.json", str(n)), range(40)))
    assert sum(won) == 1 and log._read("x.json") == str(won.index(True))
    assert log._put_by_rename("y.json", "1") and not log._put_by_rename("y.json", "2")
    assert log._read("y.json") == "1" and sorted(log._names()) == ["x.json", "y.json"]


def test_only_four_statements(spark):
    tables = {"t": spark.createDataFrame([(1, "x")], "a int, b string")}
    for text in ("CREATE TABLE x AS SELECT 1", "DROP TABLE t", "SET a = b", "CACHE TABLE t", "EXPLAIN SELECT 1", "SHOW TABLES",
                 "TRUNCATE TABLE t", "INSERT OVERWRITE t SELECT 1, 'x'", "INSERT INTO t PARTITION (a = 1) SELECT 'x'",
                 "MERGE INTO t USING t s ON t.a = s.a WHEN MATCHED THEN DELETE", "FROM t INSERT INTO t SELECT a, b INSERT INTO t SELECT a, b",
                 "SELECT TRANSFORM(a) USING 'cat' FROM t", "USE x", "ADD JAR 'x'", "DECLARE v INT",
                 "INSERT OVERWRITE DIRECTORY '/tmp/nothing' USING parquet SELECT 1", "CALL a.b()", "EXECUTE IMMEDIATE 'SELECT 1'",
                 "INSERT INTO t BY NAME SELECT 1 AS a"):
        for script in (text, f"SELECT 1; {text}", f"DELETE FROM t; {text}; SELECT 1"):
            with pytest.raises(Exception):
                sql.run(spark, tables, script)
        for statement in (sql.Select(text), sql.Insert("t", query=text)):
            with pytest.raises(Exception):
                sql.run(spark, tables, [sql.Select("SELECT 1"), statement])
    assert "a" not in {row["key"] for row in spark.sql("SET").collect()}
    state, result = sql.run(spark, tables, """WITH v AS (SELECT 'with insert into (' AS b), w AS (SELECT 5)
        INSERT INTO t (b) SELECT b FROM v; WITH x AS (SELECT count(*) AS n FROM t) SELECT n FROM x""")
    assert result.first()[0] == 2 and state["t"].where("a IS NULL").first()["b"] == "with insert into ("
    for text in ("VALUES (1)", "TABLE t", "FROM t SELECT a", "(SELECT 1) UNION ALL SELECT a FROM t"):
        assert sql.run(spark, tables, text)[1].count() >= 1
