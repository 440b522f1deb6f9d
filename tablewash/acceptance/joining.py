"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins
from .registry import query

# Whole tables; some keys on either side have no partner, and some are NULL.
SOME_CUSTOMERS = """(SELECT * REPLACE (CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN -c_custkey
  ELSE c_custkey END AS c_custkey) FROM customer)"""
SOME_ORDERS = """(SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders)"""


def _some_customers(t):
    key = F.col("c_custkey")
    return t.customer.withColumn("c_custkey", F.when(key % 11 != 0, F.when(key % 7 == 0, -key).otherwise(key)))


def _some_orders(t):
    return t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")))


def _named(orders):
    return orders.withColumnRenamed("o_custkey", "c_custkey")


@query("join_inner", "SELECT * FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t):
    return joins.normal_join(t.customer, t.orders, ["c_custkey"], ["o_custkey"])


@query("join_left", f"SELECT * FROM {SOME_ORDERS} o LEFT JOIN {SOME_CUSTOMERS} c ON o_custkey = c_custkey")
def join_left(t):
    return joins.normal_join(_some_orders(t), _some_customers(t), ["o_custkey"], ["c_custkey"], "left")


@query("join_right", f"SELECT * FROM {SOME_CUSTOMERS} c RIGHT JOIN {SOME_ORDERS} o ON o_custkey = c_custkey")
def join_right(t):
    return joins.normal_join(_some_customers(t), _some_orders(t), ["c_custkey"], ["o_custkey"], "right")


@query("join_full", f"SELECT * FROM {SOME_CUSTOMERS} c FULL JOIN {SOME_ORDERS} o ON o_custkey = c_custkey")
def join_full(t):
    return joins.normal_join(_some_customers(t), _some_orders(t), ["c_custkey"], ["o_custkey"], "full")


@query("join_two_columns", """
    SELECT * FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1) m
      ON l_orderkey = k AND l_linenumber = n""")
def join_two_columns(t):
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("n"))
    return joins.normal_join(t.lineitem, last, ["l_orderkey", "l_linenumber"], ["k", "n"])


# Two of five rows of the line items belong to one order, which exists, and some to orders that do not.
HOT_ITEMS = """(SELECT CASE WHEN l_orderkey % 5 < 2 THEN 1 WHEN l_orderkey % 17 = 3 THEN -l_orderkey
  WHEN l_orderkey % 19 <> 4 THEN l_orderkey END AS order_key, l_linenumber, l_partkey FROM lineitem)"""


def _hot_items(t):
    key = F.col("l_orderkey")
    return t.lineitem.select(F.when(key % 5 < 2, 1).when(key % 17 == 3, -key).when(key % 19 != 4, key).cast("bigint")
                             .alias("order_key"), "l_linenumber", "l_partkey")


@query("join_left_hot", f"""
    SELECT o_orderkey, o_custkey, order_key, l_linenumber, l_partkey FROM orders LEFT JOIN {HOT_ITEMS}
      ON o_orderkey = order_key""")
def join_left_hot(t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    return joins.normal_join(orders, _hot_items(t), ["o_orderkey"], ["order_key"], "left", hot_rows=1000)


@query("join_full_hot", f"""
    SELECT o_orderkey, o_custkey, order_key, l_linenumber, l_partkey FROM orders FULL JOIN {HOT_ITEMS}
      ON o_orderkey = order_key""")
def join_full_hot(t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    return joins.normal_join(orders, _hot_items(t), ["o_orderkey"], ["order_key"], "full", hot_rows=1000)


@query("natural_inner", """
    SELECT * FROM customer NATURAL JOIN (SELECT * RENAME (o_custkey AS c_custkey) FROM orders)""")
def natural_inner(t):
    return joins.natural_join(t.customer, _named(t.orders))


@query("natural_left", f"""
    SELECT * FROM {SOME_CUSTOMERS} c NATURAL LEFT JOIN (SELECT * RENAME (o_custkey AS c_custkey) FROM {SOME_ORDERS})""")
def natural_left(t):
    return joins.natural_join(_some_customers(t), _named(_some_orders(t)), "left")


@query("natural_right", f"""
    SELECT * FROM {SOME_CUSTOMERS} c NATURAL RIGHT JOIN (SELECT * RENAME (o_custkey AS c_custkey) FROM {SOME_ORDERS})""")
def natural_right(t):
    return joins.natural_join(_some_customers(t), _named(_some_orders(t)), "right")


@query("natural_full", f"""
    SELECT * FROM {SOME_CUSTOMERS} c NATURAL FULL JOIN (SELECT * RENAME (o_custkey AS c_custkey) FROM {SOME_ORDERS})""")
def natural_full(t):
    return joins.natural_join(_some_customers(t), _named(_some_orders(t)), "full")


@query("semi_join", f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {SOME_ORDERS})")
def semi_join(t):
    return joins.semi_join(t.customer, _some_orders(t), "c_custkey", "o_custkey")
