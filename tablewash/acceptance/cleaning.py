"""Columns, conversions, rows, find and replace, filling, date parts."""

from pyspark.sql import functions as F

from ..operators import columns, dates, impute, replace, rows
from .registry import query

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("drop_column", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_column(t):
    return columns.drop_column(t.customer, "c_name")


@query("rename_column", """
    SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def rename_column(t):
    return columns.rename_column(t.customer, "c_name", "full_name")


@query("rename_column_numbered", """
    SELECT c_custkey, c_name AS c_custkey_1, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def rename_column_numbered(t):
    return columns.rename_column(t.customer, "c_name", "c_custkey")


@query("rename_column_case", """
    SELECT c_custkey, c_name, c_nationkey AS "C_NAME_1", c_acctbal, c_mktsegment FROM customer""")
def rename_column_case(t):
    """A name that differs from another column's by case only gets a number."""
    return columns.rename_column(t.customer, "c_nationkey", "C_NAME")


@query("nullify_empty", """
    SELECT p_partkey, nullif(replace(p_name, 'red plate', ''), '') AS p_name FROM part""")
def nullify_empty(t):
    emptied = t.part.select("p_partkey", F.replace("p_name", F.lit("red plate"), F.lit("")).alias("p_name"))
    return columns.nullify_empty(emptied, "p_name")


@query("cast_float_to_int", "SELECT p_partkey, (p_retailprice * 5)::INT AS price FROM part")
def cast_float_to_int(t):
    df = t.part.select("p_partkey", (F.col("p_retailprice") * 5).alias("price"))
    return columns.convert(df, "price", "INTEGER")


@query("cast_float_to_text", """
    SELECT l_orderkey, l_linenumber, regexp_replace(l_extendedprice::VARCHAR, '\\.0$', '') AS price FROM lineitem""")
def cast_float_to_text(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return columns.convert(df, "price", "VARCHAR(255)")


@query("cast_small_float_to_text", """
    SELECT l_orderkey, l_linenumber, regexp_replace((l_extendedprice / 333333333)::VARCHAR, '\\.0$', '') AS share
    FROM lineitem WHERE l_extendedprice / 333333333 >= 0.0001""")
def cast_small_float_to_text(t):
    share = F.col("l_extendedprice") / 333333333
    df = t.lineitem.where(share >= 0.0001).select("l_orderkey", "l_linenumber", share.alias("share"))
    return columns.convert(df, "share", "VARCHAR(255)")


@query("cast_string_to_float", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem")
def cast_string_to_float(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("price"))
    return columns.convert(df, "price", "FLOAT")


@query("cast_string_to_varchar", "SELECT c_custkey, c_mktsegment FROM customer")
def cast_string_to_varchar(t):
    return columns.convert(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "VARCHAR(n)", length=12)


@query("cast_int_to_float", "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
def cast_int_to_float(t):
    return columns.convert(t.part.select("p_partkey", "p_size"), "p_size", "FLOAT")


@query("cast_string_to_int", "SELECT c_name, c_custkey::INT AS c_custkey FROM customer")
def cast_string_to_int(t):
    df = t.customer.select("c_name", F.col("c_custkey").cast("string").alias("c_custkey"))
    return columns.convert(df, "c_custkey", "INTEGER")


@query("cast_string_to_date", """
    SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%-d/%-m/%Y'), '%d/%m/%Y')::DATE AS o_orderdate
    FROM orders""")
def cast_string_to_date(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("o_orderdate"))
    return columns.convert(df, "o_orderdate", "DATE", "DD/MM/YYYY")


@query("cast_string_to_timestamp", """
    SELECT event_id, date_trunc('second', ts) AS ts FROM events""")
def cast_string_to_timestamp(t):
    df = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return columns.convert(df, "ts", "TIMESTAMP", "YYYY-MM-DD TIME")


@query("cast_string_to_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS ts FROM events")
def cast_string_to_time(t):
    df = t.events.select("event_id", F.date_format("ts", "hh:mm:ss a").alias("ts"))
    return columns.convert(df, "ts", "TIME", "HH12:MI:SS AM/PM")


@query("cast_date_to_text", "SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate FROM orders")
def cast_date_to_text(t):
    return columns.convert(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "VARCHAR(255)")


def _mixed_keys(t):
    """Customer keys as text, but the market segment where the balance is negative."""
    key = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    return t.customer.select("c_name", key.alias("code"))


MIXED_KEYS = """mixed AS (SELECT c_name,
    CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS code FROM customer)"""


@query("force_cast_set_null", f"""
    WITH {MIXED_KEYS} SELECT c_name,
      CASE WHEN regexp_full_match(code, '[-+]?[0-9]+') THEN try_cast(code AS INT) END AS code FROM mixed""")
def force_cast_set_null(t):
    return columns.force_convert(_mixed_keys(t), "code", "INTEGER")


@query("force_cast_delete_row", f"""
    WITH {MIXED_KEYS} SELECT c_name, code::INT AS code FROM mixed WHERE regexp_full_match(code, '[-+]?[0-9]+')""")
def force_cast_delete_row(t):
    return columns.force_convert(_mixed_keys(t), "code", "INTEGER", mode="DELETE_ROW")


@query("force_cast_float", f"""
    WITH {MIXED_KEYS} SELECT c_name,
      CASE WHEN regexp_full_match(code, '[-+]?[0-9]+') THEN code::DOUBLE END AS code FROM mixed""")
def force_cast_float(t):
    return columns.force_convert(_mixed_keys(t), "code", "FLOAT", compat_regex=True)


@query("force_cast_date", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS day FROM orders""")
def force_cast_date(t):
    day = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "MM-dd-yyyy"))
    return columns.force_convert(t.orders.select("o_orderkey", day.alias("day")), "day", "DATE", "MM-DD-YYYY")


@query("force_cast_length", """
    SELECT c_custkey, CASE WHEN length(c_mktsegment) <= 9 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def force_cast_length(t):
    return columns.force_convert(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "VARCHAR(n)", length=9)


@query("force_cast_length_delete", """
    SELECT c_custkey, c_mktsegment FROM customer WHERE length(c_mktsegment) <= 9""")
def force_cast_length_delete(t):
    return columns.force_convert(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "CHAR(n)", length=9,
                                 mode="DELETE_ROW")


@query("delete_rows_predicate", """
    SELECT * FROM orders WHERE NOT coalesce(o_totalprice > 250000 AND o_orderstatus = 'F', FALSE)""")
def delete_rows_predicate(t):
    return rows.delete_rows_where(t.orders, ["o_totalprice", ">", "250000", "AND", "o_orderstatus", "=", "F"])


@query("delete_rows_or_precedence", """
    SELECT * FROM orders
    WHERE NOT (o_orderstatus = 'P' OR o_totalprice < 100000 AND o_orderpriority != '5-LOW')""")
def delete_rows_or_precedence(t):
    return rows.delete_rows_where(t.orders, ["o_orderstatus", "=", "P", "OR", "o_totalprice", "<", 100000, "AND",
                                             "o_orderpriority", "!=", "5-LOW"])


def _orders_without_low(t):
    return t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))


NO_LOW = f"""blanked AS (SELECT {ORDERS.rsplit(',', 1)[0]}, nullif(o_orderpriority, '5-LOW') AS o_orderpriority
    FROM orders)"""


@query("delete_rows_null", f"WITH {NO_LOW} SELECT * FROM blanked WHERE o_orderpriority IS NOT NULL")
def delete_rows_null(t):
    return rows.delete_rows_where(_orders_without_low(t), ["o_orderpriority", "=", '"null"'])


@query("delete_rows_unknown_stay", f"""
    WITH {NO_LOW} SELECT * FROM blanked WHERE NOT coalesce(o_orderpriority != '1-URGENT', FALSE)""")
def delete_rows_unknown_stay(t):
    return rows.delete_rows_where(_orders_without_low(t), ["o_orderpriority", "!=", "1-URGENT"])


@query("select_where", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def select_where(t):
    return rows.select_where(t.customer, {"c_mktsegment": "BUILDING", "c_nationkey": 7})


@query("delete_where", "SELECT * FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 7)")
def delete_where(t):
    return rows.delete_where(t.customer, {"c_mktsegment": "BUILDING", "c_nationkey": 7})


@query("update_where", """
    SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS c_nationkey,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer""")
def update_where(t):
    return rows.update_where(t.customer, {"c_mktsegment": "BUILDING"}, {"c_nationkey": 0, "c_acctbal": 1.5})


@query("insert_row", """
    SELECT * FROM customer UNION ALL SELECT -1, 'New customer', NULL, 12.5, NULL""")
def insert_row(t):
    return rows.insert_row(t.customer, {"c_custkey": -1, "c_name": "New customer", "c_acctbal": "12.5"})


@query("clip_outliers_high", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 400000 ELSE o_totalprice END AS o_totalprice FROM orders""")
def clip_outliers_high(t):
    return rows.replace_outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", True, 400000, 400000)


@query("clip_outliers_low", """
    SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def clip_outliers_low(t):
    return rows.replace_outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", False, 50000, 0)


@query("replace_exact", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment
    FROM customer""")
def replace_exact(t):
    return replace.find_and_replace(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING",
                                    "CONSTRUCTION")


@query("replace_exact_number", """
    SELECT p_partkey, CASE WHEN p_size = 5 THEN 500 ELSE p_size END AS p_size FROM part""")
def replace_exact_number(t):
    return replace.find_and_replace(t.part.select("p_partkey", "p_size"), "p_size", "5", "500")


@query("replace_cell_containing", """
    SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewel' ELSE p_name END AS p_name FROM part""")
def replace_cell_containing(t):
    return replace.find_and_replace(t.part.select("p_partkey", "p_name"), "p_name", "ring", "jewel", exact=False)


@query("replace_substring", "SELECT p_partkey, replace(p_name, 'ed', 'XX') AS p_name FROM part")
def replace_substring(t):
    return replace.find_and_replace(t.part.select("p_partkey", "p_name"), "p_name", "ed", "XX", exact=False,
                                    replace_all=False)


@query("replace_regex", """
    SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(RED|hot) ', 'i') THEN 'warm' ELSE p_name END AS p_name
    FROM part""")
def replace_regex(t):
    return replace.regex_find_and_replace(t.part.select("p_partkey", "p_name"), "p_name", "^(RED|hot) ", "warm")


@query("replace_regex_texts", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '[[:digit:]]{3}-[[:digit:]]{2}') THEN 'removed' ELSE text END AS text
    FROM documents""")
def replace_regex_texts(t):
    return replace.regex_find_and_replace(t.documents.select("doc_id", "text"), "text",
                                          "[[:digit:]]{3}-[[:digit:]]{2}", "removed", case_sensitive=True)


def _gaps(t):
    """Quantities above 45 taken away."""
    quantity = F.when(F.col("l_quantity") <= 45, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", quantity.alias("l_quantity"))


GAPS = """gaps AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity <= 45 THEN l_quantity END AS l_quantity FROM lineitem)"""


def _six(df, column):
    return df.withColumn(column, F.round(column, 6))


@query("fill_mean", f"""
    WITH {GAPS} SELECT l_orderkey, l_linenumber,
      round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM gaps)), 6) AS l_quantity FROM gaps""")
def fill_mean(t):
    return _six(impute.fill_mean(_gaps(t), "l_quantity"), "l_quantity")


@query("fill_median", f"""
    WITH {GAPS} SELECT l_orderkey, l_linenumber,
      coalesce(l_quantity, (SELECT median(l_quantity) FROM gaps)) AS l_quantity FROM gaps""")
def fill_median(t):
    return impute.fill_median(_gaps(t), "l_quantity")


@query("fill_median_prices", """
    WITH gaps AS (SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(coalesce(price, (SELECT median(price) FROM gaps)), 6) AS price FROM gaps""")
def fill_median_prices(t):
    price = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    return _six(impute.fill_median(t.lineitem.select("l_orderkey", "l_linenumber", price.alias("price")), "price"),
                "price")


@query("fill_value", f"""
    WITH {GAPS} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1) AS l_quantity FROM gaps""")
def fill_value(t):
    return impute.fill_value(_gaps(t), "l_quantity", -1)


@query("fill_mean_int", """
    WITH gaps AS (SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size END AS p_size FROM part)
    SELECT p_partkey, coalesce(p_size, (SELECT round(avg(p_size)) FROM gaps))::INT AS p_size FROM gaps""")
def fill_mean_int(t):
    size = F.when(F.col("p_size") <= 40, F.col("p_size"))
    return impute.fill_mean(t.part.select("p_partkey", size.alias("p_size")), "p_size")


@query("date_year", f"SELECT {ORDERS}, year(o_orderdate)::VARCHAR AS o_orderdate_part FROM orders")
def date_year(t):
    return dates.extract_date_part(t.orders, "o_orderdate", dates.YEAR)


@query("date_month_year", f"""
    SELECT {ORDERS}, monthname(o_orderdate) || ' ' || year(o_orderdate) AS o_orderdate_part FROM orders""")
def date_month_year(t):
    return dates.extract_date_part(t.orders, "o_orderdate", dates.MONTH_YEAR)


@query("date_month", f"SELECT {ORDERS}, monthname(o_orderdate) AS o_orderdate_part FROM orders")
def date_month(t):
    return dates.extract_date_part(t.orders, "o_orderdate", dates.MONTH)


@query("date_weekday", f"SELECT {ORDERS}, dayname(o_orderdate) AS o_orderdate_part FROM orders")
def date_weekday(t):
    return dates.extract_date_part(t.orders, "o_orderdate", dates.WEEKDAY)
