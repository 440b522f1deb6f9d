"""INSERT, UPDATE, DELETE and SELECT over a set of tables, all or nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import holds
from ..types import InvalidValueError, col, type_of


@dataclass(frozen=True)
class Insert:
    """Rows given as tuples, as a query, or in a Parquet folder; ``columns`` defaults to all columns in order."""

    table: str
    rows: Sequence[Sequence] = ()
    query: str | None = None
    columns: Sequence[str] | None = None
    folder: str | None = None


@dataclass(frozen=True)
class Update:
    """Set columns to SQL expressions where a SQL condition holds; without condition in all rows."""

    table: str
    set: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: str | None = None


@dataclass(frozen=True)
class Select:
    query: str


Statement = Insert | Update | Delete | Select


def select(spark: SparkSession, tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    """Result of a query in Spark SQL over the named tables; other statements are refused before anything runs.

    The names are views for as long as the query is analysed; the caller's views of these names come back.
    """
    _require_query(_parsed(spark, query))
    before = {name: spark.table(name) for name in tables if _is_view(spark, name)}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return bool(spark.catalog._jcatalog.tableExists(name)) and spark.catalog.getTable(name).isTemporary


def parse(spark: SparkSession, text: str) -> list[Statement]:
    """The statements of an SQL text, separated by semicolons, as Spark's own parser reads them.

    UPDATE, DELETE and INSERT become statements over the named tables, everything else has to be a query. The whole text is
    read first, so one statement of another kind keeps all of them from running.
    """
    script = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"BEGIN\n{text.rstrip().rstrip(';')};\nEND")
    parts = script.collection()
    return [_statement(parts.apply(n)) for n in range(parts.size())]


def _parsed(spark: SparkSession, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


# What Spark's parser makes of the outermost part of a query.
QUERIES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset "
    "OneRowRelation Pivot Project Repartition RepartitionByExpression ResolvedInlineTable Sample Sort SubqueryAlias Tail "
    "Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Window "
    "WithWindowDefinition".split())


def _require_query(plan) -> None:
    """Raise unless a parsed statement is a query: neither it nor anything it is made of changes or sets something."""
    outer = plan
    while outer.getClass().getSimpleName() == "UnresolvedWith":
        outer = outer.child()
    for node in (outer, *_nodes(plan)):
        name = node.getClass().getSimpleName()
        # Parsed statements are those that Spark turns into commands later; a script runs programs of its own.
        kinds = {kind.getSimpleName() for kind in _kinds(node.getClass())}
        if (node is outer and name not in QUERIES) or kinds & {"Command", "ParsedStatement", "ScriptTransformation"}:
            raise InvalidValueError(f"only SELECT, INSERT, UPDATE and DELETE can be run, not {name}")


def _nodes(plan):
    """A plan and all plans below it, those of WITH included."""
    yield plan
    for below in (plan.children(), plan.innerChildren()):
        for n in range(below.size()):
            node = below.apply(n)
            if "children" in dir(node) and "innerChildren" in dir(node):
                yield from _nodes(node)


def _kinds(kind):
    """A class with everything it extends and implements."""
    while kind is not None:
        yield kind
        for face in kind.getInterfaces():
            yield from _kinds(face)
        kind = kind.getSuperclass()


def _statement(part) -> Statement:
    if part.getClass().getSimpleName() != "SingleStatement":
        raise InvalidValueError("only plain statements can be run")
    plan = part.parsedPlan()
    text = _source(part)
    kind = plan.getClass().getSimpleName()
    before = ""
    if kind == "UnresolvedWith" and plan.child().getClass().getSimpleName() == "InsertIntoStatement":
        # WITH in front of an INSERT belongs to the query whose rows are inserted.
        plan, kind = plan.child(), "InsertIntoStatement"
        before = text[:text.upper().index("INSERT", text.rindex(")", 0, text.upper().rindex("INSERT INTO")))]
    if kind == "UpdateTable":
        assignments = [plan.assignments().apply(n) for n in range(plan.assignments().size())]
        condition = plan.condition()
        return Update(_table_name(plan.table()),
                      {a.key().nameParts().last(): a.value().sql() for a in assignments},
                      condition.get().sql() if condition.isDefined() else None)
    if kind == "DeleteFromTable":
        condition = plan.condition().sql()
        return Delete(_table_name(plan.table()), None if condition == "true" else condition)
    if kind == "InsertIntoStatement":
        named = plan.userSpecifiedCols()
        names = [named.apply(n) for n in range(named.size())]
        if plan.overwrite() or plan.byName() or plan.partitionSpec().size():
            raise InvalidValueError("an INSERT adds rows to a whole table")
        query = _source(plan.query())
        _require_query(plan.query())
        return Insert(_table_name(plan.table()), query=before + query, columns=names or None)
    _require_query(plan)
    return Select(text)


def _table_name(relation) -> str:
    return relation.multipartIdentifier().last()


def _source(node) -> str:
    """The text a node of the parser was read from."""
    origin = node.origin()
    return origin.sqlText().get()[origin.startIndex().get():origin.stopIndex().get() + 1]


def insert(spark: SparkSession, tables: Mapping[str, DataFrame], statement: Insert) -> DataFrame:
    target = tables[statement.table]
    names = list(statement.columns or target.columns)
    for name in names:
        type_of(target, name)
    if statement.folder is not None:
        added = spark.read.parquet(statement.folder)
    elif statement.query is not None:
        added = select(spark, tables, statement.query).toDF(*names)
    else:
        added = spark.createDataFrame([tuple(row) for row in statement.rows],
                                      ", ".join(f"`{n}` {_input_type(target, n)}" for n in names))
    added = added.select(*[(col(c) if c in names else F.lit(None)).cast(type_of(target, c)).alias(c)
                           for c in target.columns])
    return target.unionByName(added)


def update(df: DataFrame, statement: Update) -> DataFrame:
    """All expressions see the old values; rows where the condition is unknown stay as they are."""
    if not statement.set:
        raise InvalidValueError("an update needs at least one column to set")
    hit = F.lit(True) if statement.where is None else holds(F.expr(statement.where))
    return df.withColumns({c: F.when(hit, F.expr(e).cast(type_of(df, c))).otherwise(col(c))
                           for c, e in statement.set.items()})


def delete(df: DataFrame, statement: Delete) -> DataFrame:
    if statement.where is None:
        return df.limit(0)
    return df.where(~holds(F.expr(statement.where)))


def run(spark: SparkSession, tables: Mapping[str, DataFrame], statements: Sequence[Statement] | str
        ) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Fold the statements, or those of an SQL text, over the tables: the new tables and the result of the last one.

    The given mapping is not touched, so a failing statement leaves everything as it was. Queries are read
    before the first statement runs.
    """
    state, result = dict(tables), None
    statements = parse(spark, statements) if isinstance(statements, str) else list(statements)
    check_queries(spark, statements)
    for statement in statements:
        result = None
        if isinstance(statement, Select):
            result = select(spark, state, statement.query)
            continue
        if statement.table not in state:
            raise InvalidValueError(f"there is no table {statement.table!r}")
        if isinstance(statement, Insert):
            state[statement.table] = insert(spark, state, statement)
        elif isinstance(statement, Update):
            state[statement.table] = update(state[statement.table], statement)
        else:
            state[statement.table] = delete(state[statement.table], statement)
    return state, result


def check_queries(spark: SparkSession, statements: Sequence[Statement]) -> None:
    """Raise if what a statement gives as a query is another kind of statement."""
    for statement in statements:
        if isinstance(statement, (Select, Insert)) and statement.query is not None:
            _require_query(_parsed(spark, statement.query))


def _input_type(df: DataFrame, column: str) -> str:
    return type_of(df, column).simpleString()
