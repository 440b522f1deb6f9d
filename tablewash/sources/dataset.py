"""A folder of tables: raw copies, a log of commits, and snapshots.

``original``, ``snapshots``, ``inserted`` and ``removed`` hold folders of data, each written once under a name of its own;
``log`` holds one file per commit (``commits``). The present state of a table is its newest snapshot, or
its original, with the later steps replayed as a lazy plan. Data is written first and counts only
when a commit names it, so a failure in between leaves the dataset as it was, and a commit names
the new state of all tables that it touches. Nothing that a version of the log names is ever changed:
dropping and undoing only say so in the log, and ``sweep`` removes what no kept version needs.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dedup.clusters import find_clusters, remove_rows, rows_to_remove
from ..naming import check_table_name, free_table_name
from ..plans import history as h
from ..plans.recipe import Step, apply_step, fit_step, replay, statement_record
from ..plans.statements import Insert, Select, Statement, check_queries, parse, run, select
from ..types import InvalidValueError, col
from .commits import Change, CommitLog, State, TableChange
from .csv import write_csv
from .dump import write_sql_dump
from .files import read_file

KINDS = ("original", "snapshots", "inserted", "removed")


class Dataset:
    def __init__(self, spark: SparkSession, root: str, setid: int = 0):
        self.spark = spark
        self.root = root.rstrip("/")
        self.setid = setid
        self.log = CommitLog(spark, f"{self.root}/log")

    # Folders

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _filesystem(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    @staticmethod
    def _new_folder(kind: str, name: str) -> str:
        return f"{kind}/{name}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, folder: str) -> str:
        df.write.parquet(self._path(folder))
        return folder

    def sweep(self, keep: int = 100, older_than: float = 86_400.0) -> list[str]:
        """Delete the folders of data that none of the last ``keep`` versions needs; returns their names.

        Folders younger than ``older_than`` seconds stay, as somebody may be about to commit them. Tables read from a
        version before these must not be in use any more.
        """
        needed = self.log.folders_since(self.log.state().version - keep + 1)
        oldest = (time.time() - older_than) * 1000
        swept = []
        for kind in KINDS:
            files, folder = self._filesystem(self._path(kind))
            for status in files.listStatus(folder) if files.exists(folder) else []:
                name = f"{kind}/{status.getPath().getName()}"
                if name not in needed and status.getModificationTime() <= oldest:
                    files.delete(status.getPath(), True)
                    swept.append(name)
        return sorted(swept)

    # Log

    def version(self) -> int:
        """Number of the newest commit, 0 before the first."""
        return self.log.state().version

    def _state(self, version: int | None) -> State:
        return self.log.state() if version is None else self.log.state_at(version)

    def history(self, version: int | None = None) -> DataFrame:
        """The whole log, oldest entry first; one row per step somebody asked for."""
        rows = [(*entry[:7], dt.datetime.fromisoformat(entry[7]))
                for _, entry in sorted(self._state(version).entries.items())]
        return self.spark.createDataFrame(rows, h.LOG_SCHEMA).orderBy("transformation_id")

    def _numbered(self, state: State, change: Change) -> dict:
        """A change as a commit on top of a state: entries get the numbers that follow."""
        number, tables = state.last_id, {}
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
        for name, new in change.tables.items():
            entries = []
            for table, attribute, code, parameters, origin in new.entries:
                # A snapshot names its step where others name their table.
                table = str(number) if code == h.SNAPSHOT else table
                number += 1
                entries.append((self.setid, table, attribute, code, parameters, origin, number, now))
            tables[name] = {**vars(new), "entries": entries}
        return {"tables": tables}

    def _commit(self, build) -> State:
        return self.log.commit(build, self._numbered)

    # Tables

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._state(version).tables)

    def ingest(self, path: str, header: bool = True, infer_types: bool = False) -> list[str]:
        """Read a file and keep its tables as originals, in one commit; names in use get a number."""
        return self._add(read_file(self.spark, path, header, infer_types))

    def add(self, name: str, df: DataFrame) -> str:
        return self._add({name: df})[0]

    def _add(self, tables: dict[str, DataFrame]) -> list[str]:
        folders = {name: self._write(df, self._new_folder("original", check_table_name(name)))
                   for name, df in tables.items()}
        names: list[str] = []

        def build(state: State) -> Change:
            names.clear()
            for name in folders:
                names.append(free_table_name([*state.tables, *names], name))
            return Change({name: TableChange(original=folder) for name, folder in zip(names, folders.values())})

        self._commit(build)
        return names

    @staticmethod
    def _snapshots(state: State, name: str) -> list[int]:
        return sorted(number for number, entry in state.entries.items() if entry[3] == h.SNAPSHOT and entry[5] == name)

    def _base(self, state: State, name: str) -> tuple[DataFrame, int]:
        """Newest snapshot of a table and the id of its step, or the original and 0."""
        taken = self._snapshots(state, name)
        if taken:
            return self.spark.read.parquet(self._path(state.files[taken[-1]][0])), taken[-1]
        return self._original(state, name), 0

    @staticmethod
    def _steps(state: State, name: str, after: int) -> list[Step]:
        fields = ("setid", "table_name", "attribute", "transformation_type", "parameters")
        return [Step.from_row(dict(zip(fields, entry))) for number, entry in sorted(state.entries.items())
                if entry[1] == name and entry[3] > h.COPY and number > after]

    def _original(self, state: State, name: str) -> DataFrame:
        if name not in state.originals:
            raise InvalidValueError(f"there is no original of table {name!r}")
        return self.spark.read.parquet(self._path(state.originals[name]))

    def original(self, name: str) -> DataFrame:
        return self._original(self.log.state(), name)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was in a version that has not been swept."""
        return self._table(self._state(version), name)

    def _table(self, state: State, name: str) -> DataFrame:
        if name not in state.tables:
            raise InvalidValueError(f"there is no table {name!r}")
        base, after = self._base(state, name)
        return replay(base, self._steps(state, name, after))

    def copy(self, old: str, new: str) -> str:
        """A copy under a free name; copies start from a snapshot of their own."""
        if not new:
            raise InvalidValueError("a name is needed for the new table")
        check_table_name(new)
        made = []

        def build(state: State) -> Change:
            name = free_table_name(state.tables, new)
            made.append(name)
            return Change({name: self._recorded(state, name, old, Step(h.COPY), self._table(state, old))}, {old})

        self._commit(build)
        return made[-1]

    def drop(self, name: str) -> None:
        """Remove a table with its log; its files stay for those who still read them, until they are swept."""
        self._commit(lambda state: Change({name: TableChange(dropped=True, gone=[
            number for number, entry in state.entries.items() if self._belongs(entry, name)])}))

    @staticmethod
    def _belongs(entry, name: str) -> bool:
        """Whether an entry is part of a table's log; a snapshot names its step where others name their table."""
        if entry[3] == h.SNAPSHOT:
            return entry[5] == name
        return entry[1] == name or (entry[5] == name and entry[3] != h.COPY)

    # Steps

    def apply(self, name: str, step: Step) -> DataFrame:
        """Fit the step, log it, and return the new state of the table."""
        results = []

        def build(state: State) -> Change:
            df = self._table(state, name)
            fitted = fit_step(df, step)
            if step.code in (h.CONVERT, h.FORCE_CONVERT):
                # Bad values are reported now; the replay trusts this check.
                apply_step(df, Step(step.code, step.attribute, {**step.params, "validate": True}))
            results.append(apply_step(df, fitted))
            return Change({name: self._recorded(state, name, name, fitted, results[-1])})

        self._commit(build)
        return results[-1]

    def execute(self, statements: Sequence[Statement] | str) -> DataFrame | None:
        """Run statements, or an SQL text, over the tables; log the changes of all tables in one commit, or none.

        The rows of an INSERT from a query are kept in a folder that the log refers to, so that a replay adds the same
        rows whatever becomes of the tables they came from.
        """
        parsed = parse(self.spark, statements) if isinstance(statements, str) else list(statements)
        check_queries(self.spark, parsed)
        results = []

        def build(state: State) -> Change:
            tables = {name: self._table(state, name) for name in state.tables}
            changed: dict[str, list] = {}
            files: dict[str, list[str]] = {}
            result = None
            for statement in parsed:
                if isinstance(statement, Insert) and statement.query is not None and statement.table in tables:
                    names = list(statement.columns or tables[statement.table].columns)
                    folder = self._write(select(self.spark, tables, statement.query).toDF(*names),
                                         self._new_folder("inserted", statement.table))
                    files.setdefault(statement.table, []).append(folder)
                    statement = Insert(statement.table, columns=names, folder=self._path(folder))
                tables, result = run(self.spark, tables, [statement])
                if not isinstance(statement, Select):
                    changed.setdefault(statement.table, []).append(statement_record(statement))
            for table in changed:
                # An expression that fails on some row must fail here, before anything is logged.
                tables[table].write.format("noop").mode("overwrite").save()
            results.append(result)
            new = {}
            for table, records in changed.items():
                text = "; ".join(f"{r['kind'].upper()} {table}" for r in records)
                step = Step(h.STATEMENTS, "", {"statements": records, "query": text, "table": table})
                new[table] = self._recorded(state, table, table, step, tables[table], files.get(table, []))
            return Change(new, None)

        if any(not isinstance(statement, Select) for statement in parsed):
            self._commit(build)
        else:
            build(self.log.state())
        return results[-1]

    def deduplicate(self, name: str, id_column: str, exact: Sequence[str] = (), ignore: Sequence[str] = (),
                    threshold: float | None = None, keep: DataFrame | None = None,
                    yes_from: int | None = None) -> DataFrame:
        """Remove duplicates; the removed rows are kept as a table that the log refers to."""
        results = []

        def build(state: State) -> Change:
            df = self._table(state, name)
            clusters = find_clusters(df, id_column, exact, ignore, threshold)
            gone = rows_to_remove(clusters, id_column, keep, yes_from)
            folder = self._write(df.join(gone, id_column, "left_semi").select(*[col(c) for c in df.columns]),
                                 self._new_folder("removed", name))
            path = self._path(folder)
            results.append(remove_rows(df, id_column, self.spark.read.parquet(path)))
            return Change({name: self._recorded(state, name, name, Step(h.DEDUPLICATE, "", {"removed": path}),
                                                results[-1], [folder])})

        self._commit(build)
        return results[-1]

    def _recorded(self, state: State, table: str, origin: str, step: Step, result: DataFrame,
                  files: Sequence[str] = ()) -> TableChange:
        """The step as an entry, with a snapshot of ``result`` when one is due; the newest two are kept."""
        change = TableChange(entries=[(table, step.attribute, step.code, step.to_json(), origin)], files=[list(files)])
        taken = self._snapshots(state, table)
        since = taken[-1] if taken else 0
        codes = [entry[3] for number, entry in state.entries.items() if entry[1] == table and number > since]
        spent = sum(h.HEAVY if code in h.HEAVY_STEPS else h.LIGHT for code in [*codes, step.code] if code > h.SNAPSHOT)
        if spent >= h.SNAPSHOT_COST or step.code == h.COPY:
            folder = self._write(result, self._new_folder("snapshots", table))
            marker = Step(h.SNAPSHOT)
            change.entries.append(("", marker.attribute, marker.code, marker.to_json(), table))
            change.files.append([folder])
            if len(taken) >= h.SNAPSHOTS_KEPT:
                change.gone = [taken[0]]
        return change

    def is_undo_enabled(self, name: str) -> bool:
        return self._is_undo_enabled(self.log.state(), name)

    def _is_undo_enabled(self, state: State, name: str) -> bool:
        originals = self.spark.createDataFrame([(t,) for t in state.originals], "table_name string")
        row = h.undo_enabled(self.history(state.version), originals).where(F.col("table_name") == name).first()
        return bool(row and row["undo_enabled"])

    def undo(self, name: str) -> DataFrame:
        """Take back the last step of a table; a snapshot taken right after it goes too."""

        def build(state: State) -> Change:
            if not self._is_undo_enabled(state, name):
                raise InvalidValueError(f"the last step of table {name!r} cannot be undone")
            last = max(number for number, entry in state.entries.items() if entry[1] == name and entry[3] > h.SNAPSHOT)
            if state.entries[last][3] == h.COPY:
                raise InvalidValueError("making a copy cannot be undone; drop the table")
            return Change({name: TableChange(gone=[last, *[n for n in self._snapshots(state, name) if n > last]])})

        return self._table(self._commit(build), name)

    # Export

    def export_csv(self, path: str, delimiter: str = ",", quotechar: str = '"', null: str = "NULL",
                   original: bool = False) -> None:
        """Every table as CSV; with ``original`` in ``edited/``, and the raw copies in ``original/``."""
        for name in self.tables():
            target = f"{path}/edited/{name}" if original else f"{path}/{name}"
            write_csv(self.table(name), target, delimiter, quotechar, null)
        for name in sorted(self.log.state().originals) if original else []:
            write_csv(self.original(name), f"{path}/original/{name}", delimiter, quotechar, null)

    def export_dump(self, path: str, original: bool = False) -> None:
        """Every table as SQL statements; with ``original`` the raw copies as well."""
        for name in self.tables():
            target = f"{path}/edited/{name}" if original else f"{path}/{name}"
            write_sql_dump(self.table(name), target, name)
        for name in sorted(self.log.state().originals) if original else []:
            write_sql_dump(self.original(name), f"{path}/original/{name}", name)
