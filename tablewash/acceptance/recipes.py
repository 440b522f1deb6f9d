"""History, replay, undo and SQL statements."""

from pyspark.sql import functions as F

from ..operators import encode
from ..plans import history as h
from ..plans import statements as sql
from ..plans.recipe import Step, fit, replay, undo_last
from .registry import query

# A log made of the events: one table per user, a step code per event.
LOG = """log AS (SELECT event_id + 1 AS id, 'user_' || user_id AS origin, event_type AS attribute,
      CASE WHEN value > 250 THEN -1 ELSE event_id % 20 END AS kind, ts, value::VARCHAR AS v, value > 50 AS larger,
      CASE WHEN value > 250 THEN (event_id + 1)::VARCHAR ELSE 'user_' || user_id END AS name,
      CASE WHEN event_id % 20 IN (4, 5, 6, 13, 14, 16) THEN 10 ELSE 3 END AS price
    FROM events),
    steps AS (SELECT * FROM log WHERE kind > -1)"""


def _log(t):
    number = F.col("event_id") + 1
    marker = F.col("value") > 250
    user = F.concat(F.lit("user_"), F.col("user_id"))
    parameters = F.to_json(F.struct(
        F.lit("INTEGER").alias("to_type"), (F.col("value") > 50).alias("larger"),
        F.col("value").cast("string").alias("value"), F.lit("0").alias("replacement"),
        F.array(F.lit(0), F.lit(10), F.lit(20)).alias("edges"), F.lit(5).alias("bins"), F.lit("YEAR").alias("part"),
        (F.col("event_type") == "click").alias("exact"), (F.col("event_type") == "view").alias("replace_all"),
        F.lit("^a").alias("regex"), (F.col("event_type") == "error").alias("case_sensitive"),
        (F.col("event_type") == "click").alias("overwrite"), F.lit("value > 1").alias("predicate"),
        F.lit("DELETE events").alias("query"), F.lit("renamed").alias("new_name")))
    return t.events.select(
        F.lit(0).alias("setid"), F.when(marker, number.cast("string")).otherwise(user).alias("table_name"),
        F.col("event_type").alias("attribute"),
        F.when(marker, -1).otherwise(F.col("event_id") % 20).cast("int").alias("transformation_type"),
        parameters.alias("parameters"), user.alias("origin_table"), number.alias("transformation_id"),
        F.col("ts").alias("transformation_date"))


@query("history_sentences", f"""
    WITH {LOG}, q AS (SELECT *, 'attribute "' || attribute || '" of table "' || origin || '"' AS here FROM steps)
    SELECT id AS transformation_id, ts AS transformation_date, CASE kind
      WHEN 0 THEN 'Created table "' || name || '" which is a copy of table "' || origin || '".'
      WHEN 1 THEN 'Converted ' || here || ' to type INTEGER.'
      WHEN 2 THEN 'Deleted ' || here
      WHEN 3 THEN 'Deleted outliers ' || CASE WHEN larger THEN 'larger' ELSE 'smaller' END || ' than ' || v || ' from '
        || here || ' by replacing them with the value 0.'
      WHEN 4 THEN 'Discretized ' || here || ' using custom ranges ( 0, 10, 20 ).'
      WHEN 5 THEN 'Discretized ' || here || ' in equi-frequent intervals.'
      WHEN 6 THEN 'Discretized ' || here || ' in 5 equi-distant intervals.'
      WHEN 7 THEN 'Extracted YEAR from ' || here || '.'
      WHEN 8 THEN 'Performed find-and-replace on ' || here || ' looking for ''' || v || ''', '
        || CASE WHEN attribute = 'click' THEN 'not allowing' ELSE 'allowing' END
        || ' substring matches and replacing the '
        || CASE WHEN attribute IN ('click', 'view') THEN 'whole string' ELSE 'substring' END || ' with ''0''.'
      WHEN 9 THEN 'Performed find-and-replace on ' || here || ' with the regular expression ''^a'' ('
        || CASE WHEN attribute = 'error' THEN 'case sensitive' ELSE 'case insensitive' END
        || ') replacing the matches with ''0''.'
      WHEN 10 THEN 'Filled null values with the mean (' || v || ') in ' || here || '.'
      WHEN 11 THEN 'Filled null values with the median (' || v || ') in ' || here || '.'
      WHEN 12 THEN 'Filled null values with a custom value (' || v || ') in ' || here || '.'
      WHEN 13 THEN 'Normalized ' || here || ' in range [0-1] using the Z-score.' || CASE WHEN attribute = 'click' THEN ''
        ELSE ' The normalized values have been written to a new column "' || attribute || '_normalized".' END
      WHEN 14 THEN 'Performed One-hot-encoding using ' || here || '.'
      WHEN 15 THEN 'Deleted rows from table "' || origin || '" using the following predicate: value > 1.'
      WHEN 16 THEN 'Executed user-generated query on table "' || origin || '". Used query: DELETE events'
      WHEN 17 THEN 'Renamed column "' || attribute || '" of table "' || name || '" to "renamed".'
      WHEN 18 THEN 'Deleted duplicate rows of table "' || name || '" by performing Data Deduplication.'
      WHEN 19 THEN 'Forcibly converted ' || here || ' to type INTEGER.' END AS sentence
    FROM q""")
def history_sentences(t):
    return h.describe(_log(t))


@query("history_edges", f"""
    WITH {LOG} SELECT name AS table_name, max(id) AS newest, min(id) AS oldest FROM steps GROUP BY 1""")
def history_edges(t):
    return h.edge_steps(_log(t))


@query("history_interval", f"""
    WITH {LOG} SELECT id AS transformation_id, kind::INT AS transformation_type FROM steps
    WHERE name = 'user_8' AND id >= 10 AND id < 100000 ORDER BY id""")
def history_interval(t):
    return h.steps_in_interval(_log(t), "user_8", 10, 100000).select("transformation_id", "transformation_type")


@query("history_after", f"""
    WITH {LOG} SELECT id AS transformation_id, kind::INT AS transformation_type FROM steps
    WHERE name = 'user_8' AND id > 500 ORDER BY id""")
def history_after(t):
    return h.steps_after(_log(t), "user_8", 500).select("transformation_id", "transformation_type")


@query("history_size", f"WITH {LOG} SELECT count(*) AS row_count FROM log WHERE name = 'user_8' OR origin = 'user_8'")
def history_size(t):
    return h.history_size(_log(t), "user_8")


@query("history_page", f"""
    WITH {LOG} SELECT id AS transformation_id, name AS table_name, ts AS transformation_date FROM steps
    ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50""")
def history_page(t):
    return h.history_page(_log(t), 50, 25).select("transformation_id", "table_name", "transformation_date")


@query("history_page_deep", f"""
    WITH {LOG} SELECT id AS transformation_id, name AS table_name, ts AS transformation_date FROM steps
    ORDER BY ts, id LIMIT 40 OFFSET (SELECT count(*) * 2 // 3 FROM steps)""")
def history_page_deep(t):
    log = _log(t)
    deep = h.steps(log).count() * 2 // 3
    return h.history_page(log, deep, 40, newest_first=False).select("transformation_id", "table_name", "transformation_date")


@query("history_table_distance", f"""
    WITH {LOG} SELECT name AS table_name, sum(price)::BIGINT AS distance FROM steps GROUP BY 1""")
def history_table_distance(t):
    return h.edit_distance(_log(t))


@query("history_edit_distance", f"""
    WITH {LOG} SELECT name AS table_name, id AS transformation_id,
      (sum(price) OVER (PARTITION BY name ORDER BY id))::BIGINT AS distance FROM steps""")
def history_edit_distance(t):
    return h.running_distance(_log(t))


SNAPSHOTS = f"""{LOG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM steps),
    walk(name, rn, id, state) AS (
      SELECT name, rn, id, CASE WHEN kind = 0 THEN 0 ELSE price END FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.name, n.rn, n.id, CASE WHEN n.kind = 0 OR state + n.price >= 30 THEN 0 ELSE state + n.price END
      FROM walk w JOIN numbered n ON n.name = w.name AND n.rn = w.rn + 1),
    due AS (SELECT name AS table_name, id AS transformation_id FROM walk WHERE state = 0)"""


@query("history_snapshots", f"WITH RECURSIVE {SNAPSHOTS} SELECT * FROM due")
def history_snapshots(t):
    return h.snapshot_steps(_log(t))


@query("history_kept_snapshots", f"""
    WITH RECURSIVE {SNAPSHOTS} SELECT * FROM due
    QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY transformation_id DESC) <= 2""")
def history_kept_snapshots(t):
    return h.kept_snapshots(h.snapshot_steps(_log(t)))


@query("history_undo", f"""
    WITH {LOG}, kept AS (SELECT DISTINCT 'user_' || user_id AS name FROM events WHERE value > 120),
    m AS (SELECT origin AS name, count(*) AS n, max(id) AS last FROM log WHERE kind = -1 GROUP BY 1),
    s AS (SELECT name, max(id) AS newest, n, last, coalesce(sum(price) FILTER (id < last), 0) AS distance
          FROM steps LEFT JOIN m USING (name) GROUP BY ALL)
    SELECT name AS table_name, CASE WHEN n >= 2 OR last < newest THEN TRUE
      WHEN n = 1 THEN name IN (FROM kept) AND distance <= 39 ELSE name IN (FROM kept) END AS undo_enabled FROM s""")
def history_undo(t):
    originals = t.events.where("value > 120").select(F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"))
    return h.undo_enabled(_log(t), originals)


RECIPE = [
    Step(h.OUTLIERS, "o_totalprice", {"larger": True, "value": 450000, "replacement": 450000}),
    Step(h.DATE_PART, "o_orderdate", {"part": "YEAR"}),
    Step(h.RENAME, "o_orderdate_part", {"new_name": "year"}),
    Step(h.CONVERT, "year", {"to_type": "INTEGER"}),
    Step(h.FIND_REPLACE, "o_orderpriority", {"value": "URGENT", "replacement": "URG", "exact": False,
                                             "replace_all": False}),
    Step(h.DELETE_ROWS, "", {"clauses": ["o_orderstatus", "=", "P"]}),
    Step(h.CUSTOM_RANGES, "o_totalprice", {"edges": [0, 100000, 400000]}),
    Step(h.DROP_COLUMN, "o_orderstatus"),
    Step(h.ZSCORE, "o_totalprice", {"overwrite": True}),
]
RECIPE_SQL = """clipped AS (SELECT *, least(o_totalprice, 450000) AS price FROM orders WHERE o_orderstatus <> 'P')"""
RECIPE_COLUMNS = """o_orderkey, o_custkey, o_orderdate, replace(o_orderpriority, 'URGENT', 'URG') AS o_orderpriority,
    year(o_orderdate)::INT AS year, CASE WHEN price >= 0 AND price < 100000 THEN '[0 , 100000['
      WHEN price >= 100000 AND price < 400000 THEN '[100000 , 400000[' END AS o_totalprice_categorical"""


@query("replay_recipe", f"""
    WITH {RECIPE_SQL}, z AS (SELECT *, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS z FROM clipped)
    SELECT {RECIPE_COLUMNS}, round(CASE WHEN z > 2 OR z < -2 THEN 2 ELSE z END / 4 + 0.5, 6) AS o_totalprice FROM z""")
def replay_recipe(t):
    done = replay(t.orders, fit(t.orders, RECIPE))
    return done.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("undo_last", f"WITH {RECIPE_SQL} SELECT {RECIPE_COLUMNS}, price AS o_totalprice FROM clipped")
def undo(t):
    return undo_last(t.orders, RECIPE)


REVENUE = """SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS order_year, count(*) AS n,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
    GROUP BY o_orderpriority, year(o_orderdate)"""


@query("sql_select", REVENUE)
def sql_select(t):
    return sql.select(t.spark, {"lineitem": t.lineitem, "orders": t.orders}, REVENUE)


@query("sql_insert", """
    SELECT * FROM customer UNION ALL VALUES (-1, 'One', 3, 1.5, NULL), (-2, NULL, 4, NULL, NULL)""")
def sql_insert(t):
    statement = sql.Insert("customer", [(-1, "One", 3, 1.5), (-2, None, 4, None)],
                           columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return sql.run(t.spark, {"customer": t.customer}, [statement])[0]["customer"]


@query("sql_update", """
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN round(c_acctbal * -2, 2) ELSE c_acctbal END
      AS c_acctbal, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def sql_update(t):
    statement = sql.Update("customer", {"c_acctbal": "round(c_acctbal * -2, 2)", "c_mktsegment": "upper(c_name)"},
                           "c_acctbal < 0")
    return sql.run(t.spark, {"customer": t.customer}, [statement])[0]["customer"]


@query("sql_delete", """
    SELECT * FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', FALSE)""")
def sql_delete(t):
    statement = sql.Delete("customer", "nullif(c_mktsegment, 'BUILDING') = 'MACHINERY'")
    return sql.run(t.spark, {"customer": t.customer}, [statement])[0]["customer"]


@query("sql_script", """
    WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment
               FROM customer WHERE c_nationkey <> 3
               UNION ALL SELECT s_suppkey, 'SUPPLIER' FROM supplier WHERE s_acctbal > 5000)
    SELECT segment, count(*) AS n FROM c GROUP BY 1""")
def sql_script(t):
    script = [
        sql.Delete("customer", "c_nationkey = 3"),
        sql.Update("customer", {"c_mktsegment": "'DEBT'"}, "c_acctbal < 0"),
        sql.Insert("customer", query="SELECT s_suppkey, 'SUPPLIER' FROM supplier WHERE s_acctbal > 5000",
                   columns=["c_custkey", "c_mktsegment"]),
        sql.Select("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"),
    ]
    return sql.run(t.spark, {"customer": t.customer, "supplier": t.supplier}, script)[1]


@query("sql_script_text", """
    WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DE;BT' ELSE c_mktsegment END AS segment
               FROM customer WHERE c_nationkey <> 3
               UNION ALL SELECT s_suppkey, 'SUPPLIER' FROM supplier WHERE s_acctbal > 5000)
    SELECT segment, count(*) AS n FROM c GROUP BY 1""")
def sql_script_text(t):
    script = """
        DELETE FROM customer WHERE c_nationkey = 3; -- a remark; with a semicolon
        UPDATE customer SET c_mktsegment = 'DE;BT' WHERE c_acctbal < 0;
        INSERT INTO customer (c_custkey, c_mktsegment) SELECT s_suppkey, 'SUPPLIER' FROM supplier WHERE s_acctbal > 5000;
        SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1;
        """
    return sql.run(t.spark, {"customer": t.customer, "supplier": t.supplier}, script)[1]


@query("zscore_reused", """
    SELECT o_orderkey, round(CASE WHEN z > 2 OR z < -2 THEN 2 ELSE z END / 4 + 0.5, 6) AS o_totalprice
    FROM (SELECT o_orderkey, (o_totalprice - m) / s AS z FROM orders,
      (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F'))""")
def zscore_reused(t):
    """Parameters fitted to finished orders, applied to all of them."""
    learned = encode.fit_zscore(t.orders.where("o_orderstatus = 'F'"), "o_totalprice")
    scored = encode.apply_zscore(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", learned)
    return scored.withColumn("o_totalprice", F.round("o_totalprice", 6))
