import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tablewash.operators import columns
from tablewash.plans import history as h
from tablewash.plans import statements as sql
from tablewash.plans.recipe import APPLY, Step, fit, replay, statement_record, undo_last
from tablewash.streaming.replay import replay_on_stream
from tablewash.types import InvalidValueError


def log_of(spark, entries):
    """A log from (table, kind) or (table, kind, params); snapshots name their table as origin."""
    rows = []
    for i, (table, kind, *params) in enumerate(entries, 1):
        name = str(i) if kind == h.SNAPSHOT else table
        rows.append((0, name, "col", kind, json.dumps(params[0] if params else {}), table, i,
                     dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i)))
    return spark.createDataFrame(rows, h.LOG_SCHEMA)


PARAMS = {
    h.CONVERT: {"to_type": "INTEGER"}, h.OUTLIERS: {"larger": False, "value": 3, "replacement": 0},
    h.CUSTOM_RANGES: {"edges": [0, 2.5], "exclude_right": True}, h.EQUAL_WIDTH: {"bins": 4},
    h.DATE_PART: {"part": "YEAR"},
    h.FIND_REPLACE: {"value": "a, b", "replacement": "'x'", "exact": False, "replace_all": False},
    h.REGEX_REPLACE: {"regex": "^a", "replacement": "b", "case_sensitive": True}, h.FILL_MEAN: {"value": 2.5},
    h.FILL_MEDIAN: {"value": 2}, h.FILL_VALUE: {"value": 0}, h.ZSCORE: {"overwrite": False},
    h.DELETE_ROWS: {"predicate": "a > 1"}, h.STATEMENTS: {"query": "DELETE t"}, h.RENAME: {"new_name": "new"},
    h.FORCE_CONVERT: {"to_type": "DATE"},
}


def test_sentences(spark):
    log = log_of(spark, [("t", kind, PARAMS.get(kind, {})) for kind in range(20)] + [("t", h.SNAPSHOT)])
    found = {r["transformation_id"] - 1: r["sentence"] for r in h.describe(log).collect()}
    assert sorted(found) == list(range(20)) and all(found.values())
    assert found[h.OUTLIERS] == ('Deleted outliers smaller than 3 from attribute "col" of table "t" by replacing them '
                                 'with the value 0.')
    assert found[h.CUSTOM_RANGES].endswith("using custom ranges ( 0, 2.5 ).")
    assert "looking for 'a, b', allowing substring matches and replacing the substring with ''x''" in found[h.FIND_REPLACE]
    assert found[h.FILL_MEDIAN] == 'Filled null values with the median (2) in attribute "col" of table "t".'
    assert found[h.ZSCORE].endswith('written to a new column "col_normalized".')


def test_log_queries(spark):
    log = log_of(spark, [("t", 1), ("t", 4), ("u", 2), ("t", h.SNAPSHOT), ("t", 5)])
    assert [tuple(r) for r in h.edge_steps(log).orderBy("table_name").collect()] == [("t", 5, 1), ("u", 3, 3)]
    assert [r["transformation_id"] for r in h.steps_in_interval(log, "t", 1, 5).collect()] == [1, 2]
    assert [r["transformation_id"] for r in h.steps_after(log, "t", 1).collect()] == [2, 5]
    assert {r["table_name"]: r["distance"] for r in h.edit_distance(log).collect()} == {"t": 23, "u": 3}
    assert [r["transformation_id"] for r in h.history_page(log, 1, 2).collect()] == [3, 2]
    assert [r["transformation_id"] for r in h.history_page(log, 0, 2, False, "t").collect()] == [1, 2]
    assert h.history_size(log, "t").first()[0] == 4


@pytest.mark.parametrize("piece", [3, 7, 100_000])
def test_snapshots_and_running_distance(spark, monkeypatch, piece):
    monkeypatch.setattr(h, "PIECE", piece)
    rand = random.Random(8)
    # One table holds most of the log.
    entries = [("hot" if rand.random() < 0.7 else rand.choice("ab"), rand.choice([0] + list(range(1, 20)) * 3))
               for _ in range(150)]
    due, running, state, total = [], [], {}, {}
    for i, (table, kind) in enumerate(entries, 1):
        price = h.HEAVY if kind in h.HEAVY_STEPS else h.LIGHT
        total[table] = total.get(table, 0) + price
        running.append((table, i, total[table]))
        state[table] = state.get(table, 0) + price
        if kind == 0 or state[table] >= 30:
            state[table] = 0
            due.append((table, i))
    log = log_of(spark, entries)
    assert sorted(map(tuple, h.snapshot_steps(log).collect())) == sorted(due)
    assert sorted(map(tuple, h.running_distance(log).collect())) == sorted(running)
    kept = [tuple(r) for r in h.kept_snapshots(h.snapshot_steps(log)).collect()]
    assert sorted(kept) == sorted(x for t in state for x in [d for d in due if d[0] == t][-2:])


@pytest.mark.parametrize("entries, original, enabled", [
    ([("t", 1)], True, True), ([("t", 1)], False, False),
    ([("t", h.SNAPSHOT), ("t", h.SNAPSHOT)] + [("t", 1)], False, True),
    ([("t", 1), ("t", h.SNAPSHOT), ("t", 1)], False, True),
    ([("t", 4)] * 3 + [("t", 1)] * 3 + [("t", h.SNAPSHOT)], True, True),
    ([("t", 4)] * 3 + [("t", 1)] * 3 + [("t", h.SNAPSHOT)], False, False),
    ([("t", 4)] * 3 + [("t", 1)] * 4 + [("t", h.SNAPSHOT)], True, False),
])
def test_undo_enabled(spark, entries, original, enabled):
    originals = spark.createDataFrame([("t",)] if original else [], "table_name string")
    rows = h.undo_enabled(log_of(spark, entries), originals).collect()
    assert [tuple(r) for r in rows] == [("t", enabled)]


PLAN = [
    Step(h.CONVERT, "date_string", {"to_type": "DATE", "data_format": "DD/MM/YYYY"}),
    Step(h.DATE_PART, "date_string", {"part": "MONTH"}),
    Step(h.OUTLIERS, "number", {"larger": True, "value": 20, "replacement": 20}),
    Step(h.EQUAL_WIDTH, "number", {"bins": 3}),
    Step(h.EQUAL_FREQUENCY, "number"),
    Step(h.FIND_REPLACE, "string", {"value": "Sam", "replacement": "Foo", "exact": False, "replace_all": False}),
    Step(h.REGEX_REPLACE, "string", {"regex": "^nin", "replacement": "SEGA"}),
    Step(h.STATEMENTS, "", {"statements": [
        statement_record(sql.Update("x", {"fpoint": "number / 2"}, "number > 0")),
        statement_record(sql.Insert("x", [("New", 3)], columns=["string", "number"]))]}),
    Step(h.FILL_MEAN, "fpoint"),
    Step(h.RENAME, "garbage", {"new_name": "string"}),
    Step(h.DELETE_ROWS, "", {"clauses": ["number", "<", 0]}),
    Step(h.ONE_HOT, "date_string_part"),
    Step(h.ZSCORE, "number", {"overwrite": False}),
    Step(h.FORCE_CONVERT, "string_1", {"to_type": "INTEGER"}),
    Step(h.FILL_MEDIAN, "number"), Step(h.FILL_VALUE, "string_1", {"value": 1}),
    Step(h.CUSTOM_RANGES, "number", {"edges": [0, 10, 30]}), Step(h.DROP_COLUMN, "raw_time"),
]


def test_replay_equals_direct_application(companies):
    fitted = fit(companies, PLAN)
    again = [Step.from_row({"transformation_type": s.code, "attribute": s.attribute, "parameters": s.to_json()})
             for s in fitted]
    done, stored = replay(companies, fitted), replay(companies, again)
    assert done.columns == stored.columns
    assert sorted(map(str, done.collect())) == sorted(map(str, stored.collect()))
    found = {r["string"]: r for r in done.collect()}
    assert found["SEGA"]["September"] == 1 and found["Foosung"]["fpoint"] == 3.5
    assert found["New"]["number"] == 3 and "Dummy" not in found
    assert undo_last(companies, fitted).columns[-2:] == done.columns[-2:] and "raw_time" in undo_last(companies, fitted).columns
    with pytest.raises(InvalidValueError):
        undo_last(companies, [])
    with pytest.raises(InvalidValueError):
        replay(companies, [Step(99)])
    assert set(APPLY) == set(range(20))


def test_replay_of_row_wise_steps_moves_no_data(companies):
    fitted = fit(companies, [s for s in PLAN if s.code not in (h.STATEMENTS, h.DEDUPLICATE)])
    plan = replay(companies, fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_statements(spark, companies):
    tables = {"companies": companies}
    script = [sql.Update("companies", {"number": "number + 1", "fpoint": "number"}, "number > 20"),
              sql.Delete("companies", "fpoint > 40"),
              sql.Insert("companies", query="SELECT 'Twice', number * 2 FROM companies WHERE string = 'Sony'",
                         columns=["string", "number"]),
              sql.Select("SELECT string, number, fpoint FROM companies WHERE number > 17")]
    state, result = sql.run(spark, tables, script)
    assert sorted(map(tuple, result.collect()), key=str) == [
        ("Apple", 23, 22.0), ("Nintendo", 22, 21.0), ("Nokia", 18, None), ("Twice", 18, None)]
    assert tables["companies"].count() == 16 and state["companies"].count() == 16
    assert sql.delete(companies, sql.Delete("companies")).count() == 0
    for bad in ([sql.Delete("unknown")], [sql.Update("companies")], [sql.Insert("companies", [(1,)], columns=["zz"])]):
        with pytest.raises(InvalidValueError):
            sql.run(spark, tables, bad)


def test_stream(spark, companies, tmp_path):
    folder = str(tmp_path / "in")
    companies.write.parquet(folder)
    plan = [s for s in PLAN if s.code not in (h.STATEMENTS, h.CONVERT, h.DATE_PART, h.ONE_HOT)]
    fitted = fit(companies, plan)
    stream = spark.readStream.schema(companies.schema).parquet(folder)
    query = (replay_on_stream(stream, fitted).writeStream.format("memory").queryName("cleaned")
             .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start())
    try:
        query.processAllAvailable()
        assert sorted(map(str, spark.table("cleaned").collect())) == sorted(map(str, replay(companies, fitted).collect()))
    finally:
        query.stop()
    with pytest.raises(InvalidValueError):
        replay_on_stream(stream, [Step(h.EQUAL_FREQUENCY, "number")])
    with pytest.raises(InvalidValueError):
        replay_on_stream(stream, [Step(h.DEDUPLICATE, "", {"removed": folder})])


def test_new_names_follow_the_table(companies):
    df = columns.rename_column(columns.rename_column(companies, "string", "n"), "garbage", "n")
    assert df.columns[0] == "n" and "n_1" in df.columns
    assert df.agg(F.count("n")).first()[0] == 16
