"""Recorded steps: fitting them once, and replaying them as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..dedup.clusters import redo_removal
from ..operators import columns, dates, discretize, encode, impute, replace, rows
from ..types import InvalidValueError
from . import history as h
from . import statements as sql

STATEMENT_KINDS = {"insert": sql.Insert, "update": sql.Update, "delete": sql.Delete}


@dataclass(frozen=True)
class Step:
    """One operation on one table: its code, the column it works on, and its parameters."""

    code: int
    attribute: str = ""
    params: Mapping = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(dict(self.params), default=str)

    @classmethod
    def from_row(cls, row) -> Step:
        return cls(row["transformation_type"], row["attribute"], json.loads(row["parameters"] or "{}"))


def _run_statements(df: DataFrame, table: str, statements: Iterable[Mapping]) -> DataFrame:
    parsed = []
    for statement in statements:
        kind = STATEMENT_KINDS[statement["kind"]]
        parsed.append(kind(**{**{k: v for k, v in statement.items() if k != "kind"}, "table": table}))
    return sql.run(df.sparkSession, {table: df}, parsed)[0][table]


# Steps that read the data before they change it, and what they learn.
FIT = {
    h.EQUAL_FREQUENCY: lambda df, a, p: discretize.fit_equal_frequency(df, a),
    h.EQUAL_WIDTH: lambda df, a, p: discretize.fit_equal_width(df, a, p["bins"]),
    h.FILL_MEAN: lambda df, a, p: impute.fit_mean(df, a),
    h.FILL_MEDIAN: lambda df, a, p: impute.fit_median(df, a),
    h.ZSCORE: lambda df, a, p: encode.fit_zscore(df, a),
    h.ONE_HOT: lambda df, a, p: encode.fit_one_hot(df, a),
}

# How each step changes a table, given fitted parameters.
APPLY = {
    h.COPY: lambda df, a, p: df,
    h.CONVERT: lambda df, a, p: columns.convert(
        df, a, p["to_type"], p.get("data_format", ""), p.get("length"), p.get("validate", False)),
    h.DROP_COLUMN: lambda df, a, p: columns.drop_column(df, a),
    h.OUTLIERS: lambda df, a, p: rows.replace_outliers(df, a, p["larger"], p["value"], p["replacement"]),
    h.CUSTOM_RANGES: lambda df, a, p: discretize.bin_custom(df, a, p["edges"], p.get("exclude_right", True)),
    h.EQUAL_FREQUENCY: discretize.apply_bins,
    h.EQUAL_WIDTH: discretize.apply_bins,
    h.DATE_PART: lambda df, a, p: dates.extract_date_part(df, a, p["part"]),
    h.FIND_REPLACE: lambda df, a, p: replace.find_and_replace(
        df, a, p["value"], p["replacement"], p.get("exact", True), p.get("replace_all", True)),
    h.REGEX_REPLACE: lambda df, a, p: replace.regex_find_and_replace(
        df, a, p["regex"], p["replacement"], p.get("case_sensitive", False)),
    h.FILL_MEAN: impute.apply_fill,
    h.FILL_MEDIAN: impute.apply_fill,
    h.FILL_VALUE: lambda df, a, p: impute.fill_value(df, a, p["value"]),
    h.ZSCORE: lambda df, a, p: encode.apply_zscore(
        df, a, p, p.get("overwrite", True), p.get("low_clamp", "reference")),
    h.ONE_HOT: encode.apply_one_hot,
    h.DELETE_ROWS: lambda df, a, p: rows.delete_rows_where(df, p["clauses"]),
    h.STATEMENTS: lambda df, a, p: _run_statements(df, p.get("table", "this"), p["statements"]),
    h.RENAME: lambda df, a, p: columns.rename_column(df, a, p["new_name"]),
    h.DEDUPLICATE: lambda df, a, p: redo_removal(df, df.sparkSession.read.parquet(p["removed"])),
    h.FORCE_CONVERT: lambda df, a, p: columns.force_convert(
        df, a, p["to_type"], p.get("data_format", ""), p.get("length"), p.get("mode", "SET_NULL"),
        validate=p.get("validate", False)),
}

# Steps that look at one row at a time once they are fitted.
ROW_WISE = frozenset(APPLY) - {h.STATEMENTS, h.DEDUPLICATE}


def fit_step(df: DataFrame, step: Step) -> Step:
    """The step with everything it learns from the data written into its parameters."""
    fit = FIT.get(step.code)
    if fit is None:
        return step
    return Step(step.code, step.attribute, {**step.params, **fit(df, step.attribute, step.params)})


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if step.code not in APPLY:
        raise InvalidValueError(f"unknown step {step.code}")
    return APPLY[step.code](df, step.attribute, step.params)


def fit(df: DataFrame, plan: Iterable[Step]) -> list[Step]:
    """Fit a list of steps, each to the outcome of those before it."""
    fitted = []
    for step in plan:
        step = fit_step(df, step)
        fitted.append(step)
        df = apply_step(df, step)
    return fitted


def replay(base: DataFrame, plan: Iterable[Step]) -> DataFrame:
    """Fold fitted steps over a table: one lazy plan; row-wise steps share a stage and move no data."""
    return reduce(apply_step, plan, base)


def undo_last(base: DataFrame, plan: list[Step]) -> DataFrame:
    """The table as it was before the last step."""
    if not plan:
        raise InvalidValueError("there is no step to undo")
    return replay(base, plan[:-1])


def statement_record(statement) -> dict:
    """A statement as it is written into the parameters of a step."""
    kind = type(statement).__name__.lower()
    return {"kind": kind, **{k: v for k, v in asdict(statement).items() if k != "table"}}
