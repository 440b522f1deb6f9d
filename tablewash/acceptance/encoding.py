"""One-hot encoding, normalisation and discretisation."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import discretize, encode, impute
from ..operators.profile import value_counts
from ..session import scratch_folder
from .registry import query

PRICES = "l_orderkey, l_linenumber"
# Tasks per core that write flags.
WRITE_SPREAD = 4


@query("one_hot", """
    SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS "1-URGENT", (o_orderpriority = '2-HIGH')::INT AS "2-HIGH",
      (o_orderpriority = '3-MEDIUM')::INT AS "3-MEDIUM", (o_orderpriority = '4-NOT SPECIFIED')::INT AS "4-NOT SPECIFIED",
      (o_orderpriority = '5-LOW')::INT AS "5-LOW"
    FROM orders""")
def one_hot(t):
    return encode.one_hot_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("one_hot_many", """
    SELECT part, count(*) AS row_count, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM (
      SELECT l_quantity, CASE WHEN l_partkey % 11 <> 0 THEN 'p' || l_partkey % 500 END AS part FROM lineitem)
    WHERE part IS NOT NULL GROUP BY 1""")
def one_hot_many(t):
    """Some 500 categories: the flags are turned back into one row per category."""
    part = F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("p"), F.col("l_partkey") % 500)).alias("part")
    folder = f"{scratch_folder(t.spark)}/flags"
    # Rows are few bytes and make much work, so they are dealt out evenly, however few pieces the files can be read in.
    rows = t.lineitem.select("l_quantity", part).repartition(WRITE_SPREAD * t.spark.sparkContext.defaultParallelism)
    encoded = encode.one_hot_encode(rows, "part")
    # Runs of equal flags are cheaper to write as differences than by a dictionary of each column.
    encoded.write.options(**{"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}).parquet(folder)
    flags = t.spark.read.parquet(folder)
    names = [name for name in flags.columns if name != "l_quantity"]
    # One comparison a flag up to the first one that is set; no array of all flags is made for each row.
    none = F.when(F.lit(False), F.lit(None).cast("string"))
    part = reduce(lambda cases, name: cases.when(F.col(name) == 1, name), names, none)
    return (flags.select("l_quantity", part.alias("part")).where("part IS NOT NULL").groupBy("part")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")))


@query("one_hot_null", """
    SELECT o_orderkey, coalesce((s = 'F')::INT, 0) AS "F", coalesce((s = 'O')::INT, 0) AS "O"
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def one_hot_null(t):
    return encode.one_hot_encode(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")), "s")


SCORES = f"""scores AS (SELECT {PRICES}, l_extendedprice AS price,
    (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS z FROM lineitem)"""


def _prices(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("zscore", f"""
    WITH {SCORES} SELECT {PRICES},
      round(CASE WHEN z > 2 OR z < -2 THEN 2 ELSE z END / 4 + 0.5, 6) AS price FROM scores""")
def zscore(t):
    return encode.zscore_normalize(_prices(t), "price").withColumn("price", F.round("price", 6))


@query("zscore_new_column", f"""
    WITH {SCORES} SELECT {PRICES}, price,
      round(CASE WHEN z > 2 OR z < -2 THEN 2 ELSE z END / 4 + 0.5, 6) AS price_normalized FROM scores""")
def zscore_new_column(t):
    scored = encode.zscore_normalize(_prices(t), "price", overwrite=False)
    return scored.withColumn("price_normalized", F.round("price_normalized", 6))


@query("zscore_symmetric", """
    WITH scores AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events)
    SELECT event_id, round(greatest(least(z, 2), -2) / 4 + 0.5, 6) AS value FROM scores""")
def zscore_symmetric(t):
    scored = encode.zscore_normalize(t.events.select("event_id", "value"), "value", low_clamp="symmetric")
    return scored.withColumn("value", F.round("value", 6))


@query("bin_equal_width_int", """
    WITH f AS (SELECT min(p_size) AS lo, ceil(ceil((ceil((max(p_size) + 0.0001) * 1000) / 1000 - min(p_size))
                 / 7 * 1000) / 1000)::BIGINT AS w FROM part)
    SELECT p_partkey, p_size,
      '[' || (lo + ((p_size - lo) // w) * w) || ' , ' || (lo + ((p_size - lo) // w + 1) * w) || '[' AS p_size_categorical
    FROM part, f""")
def bin_equal_width_int(t):
    return discretize.bin_equal_width(t.part.select("p_partkey", "p_size"), "p_size", 7)


@query("bin_equal_width_float", """
    WITH RECURSIVE f AS (
      SELECT floor(min(o_totalprice) * 1000) / 1000 AS lo, ceil((max(o_totalprice) + 0.0001) * 1000) / 1000 AS hi
      FROM orders),
    w AS (SELECT lo, round(ceil((hi - lo) / 6 * 1000) / 1000, 3) AS w FROM f),
    e(i, a, b) AS (SELECT 0, lo, round(lo + w, 3) FROM w
                   UNION ALL SELECT i + 1, b, round(b + w, 3) FROM e, w WHERE i < 5)
    SELECT o_orderkey, o_totalprice, '[' || a || ' , ' || b || '[' AS o_totalprice_categorical
    FROM orders LEFT JOIN e ON o_totalprice >= a AND o_totalprice < b""")
def bin_equal_width_float(t):
    return discretize.bin_equal_width(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 6)


def _equal_frequency_sql(table: str, keys: str, column: str, edge: str, label: str) -> str:
    return f"""
    WITH s AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n
               FROM {table}),
    k AS (SELECT n, greatest(2, least(20, floor(sqrt(n))))::BIGINT AS k FROM s LIMIT 1),
    ranks AS (SELECT 0::BIGINT AS i, TRUE AS first
              UNION ALL SELECT j * (n // k) + least(j, n % k) - 1, FALSE FROM (SELECT n, k, unnest(range(1, k + 1)) AS j FROM k)),
    edges AS (SELECT DISTINCT CASE WHEN first THEN v ELSE {edge} END::DOUBLE AS e FROM ranks JOIN s USING (i)),
    bins AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) AS nr FROM edges)
    SELECT {keys}, {column}, '[' || {label.format(e='lo')} || ' , ' || {label.format(e='hi')} || '[' AS {column}_categorical
    FROM {table} LEFT JOIN bins ON {column} >= lo AND {column} < hi"""


@query("bin_equal_freq_int", _equal_frequency_sql("part", "p_partkey", "p_size", "ceil(v + 0.0001)", "{e}::BIGINT"))
def bin_equal_freq_int(t):
    return discretize.bin_equal_frequency(t.part.select("p_partkey", "p_size"), "p_size")


@query("bin_equal_freq_unit", _equal_frequency_sql("lineitem", PRICES, "l_discount", "round(v + 0.05, 1)", "{e}"))
def bin_equal_freq_unit(t):
    return discretize.bin_equal_frequency(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query("bin_equal_freq_float", _equal_frequency_sql(
    "lineitem", PRICES, "l_extendedprice", "ceil(v + 0.0001)", "regexp_replace({e}::VARCHAR, '\\.0$', '')"))
def bin_equal_freq_float(t):
    return discretize.bin_equal_frequency(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"),
                                          "l_extendedprice")


EPOCH = "(SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)"


def _epoch(t):
    return t.events.select("event_id", F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ms"))


@query("bin_equal_freq_epoch", _equal_frequency_sql(EPOCH, "event_id", "ms", "v + 1", "{e}::BIGINT"))
def bin_equal_freq_epoch(t):
    """Milliseconds since 1970: numbers beyond the reach of a small addition in floating point."""
    return discretize.bin_equal_frequency(_epoch(t), "ms")


@query("bin_equal_width_bigint", f"""
    WITH e AS (SELECT event_id, ms * 100000 AS ms FROM {EPOCH}),
    f AS (SELECT min(ms) AS lo, (max(ms) - min(ms)) // 9 + 1 AS w FROM e)
    SELECT event_id, ms, '[' || (lo + ((ms - lo) // w) * w) || ' , ' || (lo + ((ms - lo) // w + 1) * w) || '['
      AS ms_categorical FROM e, f""")
def bin_equal_width_bigint(t):
    return discretize.bin_equal_width(_epoch(t).withColumn("ms", F.col("ms") * 100000), "ms", 9)


@query("one_hot_case", """
    SELECT c_custkey, (s = 'BUILDING')::INT AS "BUILDING", (s = 'FURNITURE')::INT AS "FURNITURE",
      (s = 'building')::INT AS "building_1" FROM (
        SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'building'
          WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE 'FURNITURE' END AS s FROM customer)""")
def one_hot_case(t):
    """Values that differ by case only, written to Parquet and read back."""
    building = F.col("c_mktsegment") == "BUILDING"
    segment = (F.when(building & (F.col("c_custkey") % 2 == 0), "building").when(building, "BUILDING")
               .otherwise("FURNITURE"))
    folder = f"{scratch_folder(t.spark)}/one_hot"
    encode.one_hot_encode(t.customer.select("c_custkey", segment.alias("s")), "s").write.parquet(folder)
    return t.spark.read.parquet(folder)


@query("bin_custom_right_open", f"""
    SELECT {PRICES}, l_quantity, CASE WHEN l_quantity >= 5 AND l_quantity < 15 THEN '[5 , 15['
      WHEN l_quantity >= 15 AND l_quantity < 40 THEN '[15 , 40[' END AS l_quantity_categorical FROM lineitem""")
def bin_custom_right_open(t):
    return discretize.bin_custom(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity",
                                 [5, 15, 40])


@query("bin_custom_left_open", f"""
    SELECT {PRICES}, l_quantity, CASE WHEN l_quantity > 5 AND l_quantity <= 15 THEN ']5 , 15]'
      WHEN l_quantity > 15 AND l_quantity <= 40 THEN ']15 , 40]' END AS l_quantity_categorical FROM lineitem""")
def bin_custom_left_open(t):
    return discretize.bin_custom(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity",
                                 [5, 15, 40], exclude_right=False)


@query("fill_bin_count", """
    WITH RECURSIVE gaps AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
    filled AS (SELECT coalesce(price, (SELECT avg(price) FROM gaps)) AS price FROM gaps),
    f AS (SELECT floor(min(price) * 1000) / 1000 AS lo, ceil((max(price) + 0.0001) * 1000) / 1000 AS hi FROM filled),
    w AS (SELECT lo, round(ceil((hi - lo) / 10 * 1000) / 1000, 3) AS w FROM f),
    e(i, a, b) AS (SELECT 0, lo, round(lo + w, 3) FROM w
                   UNION ALL SELECT i + 1, b, round(b + w, 3) FROM e, w WHERE i < 9)
    SELECT '[' || a || ' , ' || b || '[' AS value, count(*) AS frequency
    FROM filled LEFT JOIN e ON price >= a AND price < b GROUP BY ALL""")
def fill_bin_count(t):
    """Fill, discretise and count: the flagship query."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    filled = impute.fill_mean(t.orders.select(price.alias("price")), "price")
    return value_counts(discretize.bin_equal_width(filled, "price", 10), "price_categorical")
