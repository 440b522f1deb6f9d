"""Sources and sinks, written to scratch folders and read back."""

import uuid
import zipfile
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from ..plans import history as h
from ..plans.recipe import Step
from ..sources import csv, dump
from ..sources.archive import csv_members, read_csv_members
from ..sources.dataset import Dataset
from .registry import query

CUSTOMER_TEXT = """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
    c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer"""


@query("csv_roundtrip", CUSTOMER_TEXT)
def csv_roundtrip(t):
    folder = f"{scratch_folder(t.spark)}/customer"
    csv.write_csv(t.customer, folder)
    return csv.read_csv_raw(t.spark, folder)


@query("csv_raw_headerless", """
    SELECT c_custkey::VARCHAR AS column_0, c_name AS column_1, c_nationkey::VARCHAR AS column_2 FROM customer""")
def csv_raw_headerless(t):
    folder = f"{scratch_folder(t.spark)}/customer"
    t.customer.select("c_custkey", "c_name", "c_nationkey").write.csv(folder)
    return csv.read_csv_raw(t.spark, folder, header=False)


@query("csv_archive", """
    SELECT c_custkey::VARCHAR AS c_custkey, c_name, o_orderkey::VARCHAR AS o_orderkey, o_totalprice::VARCHAR AS o_totalprice
    FROM customer JOIN orders ON c_custkey = o_custkey""")
def csv_archive(t):
    """Archives that tasks pack from two tables, a member of each table in each; they grow in number and size."""
    folder = scratch_folder(t.spark)
    customers = t.customer.select(F.lit("customer").alias("table"), "c_custkey", F.concat_ws(",", "c_custkey", "c_name").alias("line"))
    orders = t.orders.select(F.lit("orders").alias("table"), "o_custkey",
                             F.concat_ws(",", "o_orderkey", "o_custkey", F.col("o_totalprice").cast("string")).alias("line"))
    rows = customers.unionAll(orders).repartition(8, "c_custkey").sortWithinPartitions("table")
    headers = {"customer": "c_custkey,c_name", "orders": "o_orderkey,o_custkey,o_totalprice"}
    written = rows.mapInArrow(_pack(folder, headers), "path string").distinct().count()
    members = csv_members(t.spark, f"{folder}/*.zip")
    if len(members) > 2 * written:
        raise RuntimeError("there are more members than were packed")
    tables = {name: read_csv_members(t.spark, [m for m in members if m["member"] == f"{name}.csv"]) for name in headers}
    return (tables["customer"].join(tables["orders"], F.col("c_custkey") == F.col("o_custkey"))
            .select("c_custkey", "c_name", "o_orderkey", "o_totalprice"))


def _pack(folder: str, headers: dict[str, str]):
    """Each task writes one archive under a name of its partition; a second try writes the same one again."""

    def pack(batches):
        from pyarrow import fs

        files, where = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith(("/", "file:")) else f"/{folder}")
        part = TaskContext.get().partitionId()
        files.create_dir(where, recursive=True)
        draft, path = f"{where}/.{part}-{uuid.uuid4().hex}", f"{where}/{part}.zip"
        with files.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            member, name = None, None
            for batch in batches:
                for table, line in zip(batch["table"].to_pylist(), batch["line"].to_pylist()):
                    if table != name:
                        if member is not None:
                            member.close()
                        name, member = table, archive.open(f"{table}.csv", "w", force_zip64=True)
                        member.write(headers[table].encode())
                    member.write(b"\n" + line.encode())
            if member is not None:
                member.close()
        files.move(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return pack


@query("dataset_export_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part WHERE p_size <= 40")
def dataset_export_csv(t):
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("part", t.part)
    dataset.apply("part", Step(h.DELETE_ROWS, "", {"clauses": ["p_size", ">", "40"]}))
    folder = scratch_folder(t.spark)
    dataset.export_csv(folder, original=True)
    return csv.read_csv_raw(t.spark, f"{folder}/edited/part").select("p_partkey", "p_name")


@query("dataset_export_dump", "SELECT * FROM part WHERE p_size > 40")
def dataset_export_dump(t):
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("part", t.part)
    dataset.apply("part", Step(h.DELETE_ROWS, "", {"clauses": ["p_size", "<=", "40"]}))
    folder = scratch_folder(t.spark)
    dataset.export_dump(folder)
    return dump.read_sql_dump(t.spark, f"{folder}/part/*")["part"]


@query("dataset_drop", "SELECT * FROM part")
def dataset_drop(t):
    """A table whose name is the number of another table's snapshot goes without harm to that."""
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("part", t.part)
    copy = dataset.copy("part", "c")
    dataset.add("1", t.region)
    dataset.drop("1")
    dataset.drop("part")
    return dataset.table(copy)


@query("dataset_tables", """
    SELECT 'nation' AS name, count(*) AS row_count FROM nation UNION ALL SELECT 'part', count(*) FROM part
    UNION ALL SELECT 'part_1', count(*) FROM part""")
def dataset_tables(t):
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    for name in ("part", "nation", "region"):
        dataset.add(name, getattr(t, name))
    dataset.copy("part", "part")
    dataset.drop("region")
    counts = [dataset.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"))
              for name in dataset.tables()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("dataset_insert_select", """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT s_suppkey, 'SUPPLIER;' FROM supplier WHERE s_acctbal > 5000""")
def dataset_insert_select(t):
    """An SQL text with an INSERT from a query, replayed after the queried table is gone."""
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("customer", t.customer)
    dataset.add("supplier", t.supplier)
    dataset.execute("""DELETE FROM customer WHERE c_acctbal < 0;
        INSERT INTO customer (c_custkey, c_mktsegment) SELECT s_suppkey, 'SUPPLIER;' FROM supplier WHERE s_acctbal > 5000;
        DELETE FROM supplier""")
    return dataset.table("customer").select("c_custkey", "c_mktsegment")


@query("dataset_two_tables", """
    SELECT 'customer' AS name, c_custkey AS id, round(c_acctbal * 2, 2) AS balance FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT 'customer', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 0""")
def dataset_two_tables(t):
    """One script over two tables, after one that fails at its second table and leaves both as they were."""
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("customer", t.customer)
    dataset.add("supplier", t.supplier)
    try:
        dataset.execute("DELETE FROM supplier; UPDATE customer SET c_acctbal = CAST(c_name AS DOUBLE)")
    except Exception as failure:
        if "CAST_INVALID_INPUT" not in str(failure):
            raise
    dataset.execute("""DELETE FROM customer WHERE c_acctbal <= 0; UPDATE customer SET c_acctbal = round(c_acctbal * 2, 2);
        INSERT INTO customer (c_custkey, c_acctbal) SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0;
        DELETE FROM supplier WHERE s_acctbal < 0""")
    return (dataset.table("customer").select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"),
                                             F.col("c_acctbal").alias("balance"))
            .unionByName(dataset.table("supplier").select(F.lit("supplier").alias("name"), F.col("s_suppkey").alias("id"),
                                                          F.col("s_acctbal").alias("balance"))))


@query("sql_dump_foreign", """
    SELECT doc_id, text || '; -- it''s (not) a comment' AS text, lang FROM documents""")
def sql_dump_foreign(t):
    """A dump as other programs write it: many rows in one INSERT, texts with semicolons, quotes, brackets and line breaks."""
    folder = scratch_folder(t.spark)
    text = F.concat("text", F.lit("; -- it's (not) a comment"))

    def quoted(value):
        return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

    rows = F.concat(F.lit("("), F.concat_ws(", ", F.coalesce(F.col("doc_id").cast("string"), F.lit("NULL")), quoted(text),
                                            quoted(F.col("lang"))), F.lit(")"))
    part = t.documents.select(rows.alias("value"), F.spark_partition_id().alias("part"))
    # Every part of the table becomes a file that holds one statement: its beginning, its rows, its end.
    first, last = Window.partitionBy("part").orderBy("place"), F.count(F.lit(1)).over(Window.partitionBy("part"))
    numbered = (part.withColumn("place", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(first))
                .withColumn("size", last))
    begin = F.when(F.col("n") == 1, "/* it's a part; */ INSERT INTO docs VALUES ").otherwise("  ")
    end = F.when(F.col("n") == F.col("size"), ";").otherwise(",")
    numbered.sortWithinPartitions("part", "n").select(F.concat(begin, "value", end)).write.text(f"{folder}/rows")
    t.spark.createDataFrame([("-- the table's columns;\nCREATE TABLE docs (doc_id BIGINT, text TEXT, lang TEXT);",)],
                            "value string").coalesce(1).write.text(f"{folder}/schema")
    return dump.read_sql_dump(t.spark, f"{folder}/*")["docs"]


@query("csv_null_roundtrip", """
    SELECT c_custkey::VARCHAR AS c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""")
def csv_null_roundtrip(t):
    folder = f"{scratch_folder(t.spark)}/customer"
    df = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    csv.write_csv(df, folder, null="\\N")
    return csv.read_csv_raw(t.spark, folder)


@query("csv_typed_roundtrip", """
    SELECT o_orderkey::INT AS o_orderkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate,
      o_orderdate::DATE AS day FROM orders""")
def csv_typed_roundtrip(t):
    folder = f"{scratch_folder(t.spark)}/orders"
    day = F.date_format("o_orderdate", "d/M/yyyy").alias("day")
    csv.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", day), folder)
    return csv.read_csv_typed(t.spark, folder)


@query("csv_texts_roundtrip", "SELECT doc_id::INT AS doc_id, text, lang FROM documents")
def csv_texts_roundtrip(t):
    folder = f"{scratch_folder(t.spark)}/documents"
    csv.write_csv(t.documents.select("doc_id", "text", "lang"), folder)
    return csv.read_csv_typed(t.spark, folder)


@query("sql_dump_rows", """
    SELECT 'INSERT INTO "customer" VALUES (' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', '
      || c_acctbal || ', ' || coalesce('''' || nullif(c_mktsegment, 'BUILDING') || '''', 'NULL') || ');' AS value
    FROM customer""")
def sql_dump_rows(t):
    df = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return dump.sql_dump_rows(df, "customer")


@query("sql_dump_roundtrip", "SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority || '''s' AS note FROM orders")
def sql_dump_roundtrip(t):
    folder = f"{scratch_folder(t.spark)}/orders"
    note = F.concat("o_orderpriority", F.lit("'s")).alias("note")
    dump.write_sql_dump(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", note), folder, "orders")
    return dump.read_sql_dump(t.spark, f"{folder}/*")["orders"]


@query("dataset_copy", "SELECT * FROM part")
def dataset_copy(t):
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("part", t.part)
    return dataset.table(dataset.copy("part", "part"))


@query("dataset_undo", """
    SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size, p_retailprice,
      CASE WHEN p_size < 20 THEN '[0 , 20[' ELSE '[20 , 60[' END AS p_size_categorical
    FROM part WHERE p_type <> 'PROMO'""")
def dataset_undo(t):
    """Four steps, the last one taken back."""
    dataset = Dataset(t.spark, scratch_folder(t.spark))
    dataset.add("part", t.part)
    for step in (Step(h.OUTLIERS, "p_size", {"larger": True, "value": 40, "replacement": 40}),
                 Step(h.CUSTOM_RANGES, "p_size", {"edges": [0, 20, 60]}),
                 Step(h.DELETE_ROWS, "", {"clauses": ["p_type", "=", "PROMO"]}),
                 Step(h.ONE_HOT, "p_type")):
        dataset.apply("part", step)
    return dataset.undo("part")
