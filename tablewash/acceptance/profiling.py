"""Statistics, charts, histograms, pages and JSON rows."""

from pyspark.sql import functions as F

from ..operators import joins, profile
from .registry import query


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def row_count(t):
    return profile.row_count(t.lineitem)


@query("column_max", "SELECT max(l_extendedprice) AS max FROM lineitem")
def column_max(t):
    return profile.column_max(t.lineitem, "l_extendedprice")


@query("column_min", "SELECT min(l_extendedprice) AS min FROM lineitem")
def column_min(t):
    return profile.column_min(t.lineitem, "l_extendedprice")


@query("column_avg", "SELECT round(avg(l_extendedprice), 4) AS avg FROM lineitem")
def column_avg(t):
    return profile.column_avg(t.lineitem, "l_extendedprice").withColumn("avg", F.round("avg", 4))


@query("column_max_text", "SELECT CASE WHEN count(*) >= 0 THEN 'N/A' END AS max FROM customer")
def column_max_text(t):
    return profile.column_max(t.customer, "c_name")


@query("null_frequency", "SELECT count(*) FILTER (l_quantity > 45) AS null_count FROM lineitem")
def null_frequency(t):
    quantity = F.when(F.col("l_quantity") <= 45, F.col("l_quantity"))
    return profile.null_frequency(t.lineitem.select(quantity.alias("l_quantity")), "l_quantity")


@query("most_frequent", """
    SELECT p_name AS value, count(*) AS frequency FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def most_frequent(t):
    return profile.most_frequent_value(t.part, "p_name")


@query("most_frequent_null", """
    SELECT nullif(p_brand, 'Brand#2') AS value, count(*) AS frequency FROM part GROUP BY 1
    ORDER BY 2 DESC, 1 NULLS LAST LIMIT 1""")
def most_frequent_null(t):
    return profile.most_frequent_value(t.part.select(F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand")), "p_brand")


FREQUENCY = """
    WITH c AS (SELECT {column} AS v, count(*) AS n, (SELECT count(*) FROM {table}) AS total FROM {table} GROUP BY 1)
    SELECT CASE WHEN n * 20 < total THEN 'other' ELSE v::VARCHAR END AS label, sum(n)::BIGINT AS frequency,
      n * 20 < total AS is_other FROM c GROUP BY 1, 3"""


@query("frequency_other", FREQUENCY.format(table="part", column="p_brand"))
def frequency_other(t):
    return profile.frequency_chart(t.part, "p_brand")


@query("frequency_chart", FREQUENCY.format(table="lineitem", column="l_linenumber"))
def frequency_chart(t):
    return profile.frequency_chart(t.lineitem, "l_linenumber")


@query("frequency_source", FREQUENCY.format(table="documents", column="lang"))
def frequency_source(t):
    return profile.frequency_chart(t.documents, "lang")


@query("group_having", """
    SELECT o_custkey AS value, count(*) AS frequency FROM orders GROUP BY 1 HAVING count(*) = 10""")
def group_having(t):
    return profile.frequent_values(t.orders, "o_custkey", F.col("frequency") == 10)


HISTOGRAM = """
    WITH f AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (max({c})::DOUBLE - min({c})) / 10 AS w FROM {t}),
    n AS (SELECT least(floor(({c} - lo) / w), 9)::INT AS bin, count(*) AS n FROM {t}, f GROUP BY 1),
    b AS (SELECT unnest(range(10))::INT AS bin)
    SELECT b.bin, '(' || ceil(lo + b.bin * w)::BIGINT || ', '
      || floor(CASE WHEN b.bin = 9 THEN hi ELSE lo + (b.bin + 1) * w END)::BIGINT || ')' AS label,
      coalesce(n, 0) AS frequency
    FROM b CROSS JOIN f LEFT JOIN n ON b.bin = n.bin"""


@query("histogram", HISTOGRAM.format(t="lineitem", c="l_extendedprice"))
def histogram(t):
    return profile.histogram(t.lineitem, "l_extendedprice")


@query("histogram_int", HISTOGRAM.format(t="part", c="p_size"))
def histogram_int(t):
    return profile.histogram(t.part, "p_size")


# Each edge is the one before plus the width, so that rounding adds up as in a walk.
GREEDY = """
    WITH RECURSIVE f AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (max({c})::DOUBLE - min({c})) / 10 AS w
      FROM {t}),
    e(bin, a, b) AS (SELECT 0, lo, lo + w FROM f UNION ALL SELECT bin + 1, b, b + w FROM e, f WHERE b <= hi),
    s AS (SELECT bin AS t, row_number() OVER (ORDER BY {c}) - 1 AS i FROM {t} JOIN e ON {c} >= a AND {c} < b),
    g AS (SELECT (i + min(t - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))::INT AS bin FROM s)
    SELECT bin, '(' || ceil(a)::BIGINT || ', ' || floor(b)::BIGINT || ')' AS label, count(*) AS frequency
    FROM g JOIN e USING (bin) GROUP BY 1, 2"""


@query("histogram_greedy", GREEDY.format(t="part", c="p_size"))
def histogram_greedy(t):
    return profile.histogram(t.part, "p_size", compat="greedy")


@query("histogram_greedy_skewed", GREEDY.format(t="events", c="value"))
def histogram_greedy_skewed(t):
    return profile.histogram(t.events, "value", compat="greedy")


@query("histogram_greedy_narrow", """
    SELECT 0 AS bin, '(' || 100000000000000000 || ', ' || 100000000000000016 || ')' AS label,
      count(*) FILTER (event_id % 2 = 0) AS frequency FROM events
    UNION ALL SELECT 1, '(' || 100000000000000016 || ', ' || 100000000000000032 || ')',
      count(*) FILTER (event_id % 2 = 1) FROM events""")
def histogram_greedy_narrow(t):
    """Large keys whose spread is one step of a double: the width of a bin vanishes in rounding."""
    key = (F.lit(10 ** 17) + (F.col("event_id") % 2) * 16).cast("long")
    return profile.histogram(t.events.select(key.alias("key")), "key", compat="greedy")


def _profile_sql(column: str, numeric: bool, table: str = "part", digits: int = 6) -> str:
    low, high, mean = ((f"min({column})::VARCHAR", f"max({column})::VARCHAR", f"round(avg({column}), {digits})") if numeric
                       else ("'N/A'", "'N/A'", "NULL::DOUBLE"))
    mode = f"(SELECT {column} AS v, count(*) AS n FROM {table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"
    return f"""SELECT '{column}' AS "column", count(*) AS row_count, 0::BIGINT AS null_count, {low} AS min, {high} AS max,
      {mean} AS avg, (SELECT v::VARCHAR FROM {mode}) AS most_frequent, (SELECT n FROM {mode}) AS most_frequent_count
      FROM {table}"""


@query("profile_table", " UNION ALL ".join(_profile_sql(c, c in ("p_partkey", "p_size", "p_retailprice")) for c in (
    "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def profile_table(t):
    return profile.column_profile(t.part).withColumn("avg", F.round("avg", 6))


WIDE = {"l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True,
        "l_discount": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False}


@query("profile_wide", " UNION ALL ".join(_profile_sql(c, numeric, "lineitem", 4) for c, numeric in WIDE.items()))
def profile_wide(t):
    """Nine columns of the longest table: keys whose values are all counted, and columns that a sketch decides."""
    return profile.column_profile(t.lineitem, list(WIDE)).withColumn("avg", F.round("avg", 4))


@query("page_sorted", """
    SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def page_sorted(t):
    return profile.page(t.orders, 100, 50, "o_totalprice", tiebreak=["o_orderkey"])


@query("page_deep", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 100 OFFSET (SELECT count(*) * 3 // 4 FROM lineitem)""")
def page_deep(t):
    """A page beyond most of the rows."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return profile.page(rows, rows.count() * 3 // 4, 100, "l_extendedprice", tiebreak=["l_orderkey", "l_linenumber"])


@query("page_descending_nulls_first", """
    SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders
    ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 20""")
def page_descending(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return profile.page(df, 20, 50, "p", ascending=False, tiebreak=["o_orderkey"])


@query("json_rows", """
    SELECT '[' || c_custkey || ', "' || c_name || '", ' || c_nationkey || ', ' || c_acctbal || ', "' || c_mktsegment
      || '"]' AS "row" FROM customer""")
def json_rows(t):
    return profile.to_json_rows(t.customer)


@query("json_rows_dates", """
    SELECT '["' || o_orderdate || '", ' || coalesce('"' || nullif(o_orderpriority, '5-LOW') || '"', 'null') || ']' AS "row"
    FROM orders""")
def json_rows_dates(t):
    return profile.to_json_rows(t.orders.select("o_orderdate", F.nullif("o_orderpriority", F.lit("5-LOW"))))


@query("join_then_profile", """
    SELECT n_name AS value, count(*) AS frequency FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join_then_profile(t):
    return profile.value_counts(joins.normal_join(t.customer, t.nation, ["c_nationkey"], ["n_nationkey"]), "n_name")
