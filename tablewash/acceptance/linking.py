"""Record linkage."""

from pyspark.sql import functions as F

from ..dedup import candidates as cand
from ..dedup import clusters as link
from ..dedup.matching import similarity_vectors
from .registry import query

BLOCK = ["p_name", "p_brand"]


def _similar(a: str, b: str) -> str:
    return f"""CASE WHEN {a} = '' OR {b} = '' OR {a} IS NULL OR {b} IS NULL THEN 0.0
        ELSE 1 - damerau_levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"""


PART_PAIRS = f"""pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b, {_similar('a.p_type', 'b.p_type')} AS s0,
      {_similar('a.p_size::VARCHAR', 'b.p_size::VARCHAR')} AS s1,
      {_similar('a.p_retailprice::VARCHAR', 'b.p_retailprice::VARCHAR')} AS s2
    FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)"""

COMPONENTS = """links AS MATERIALIZED (SELECT a, b FROM matches UNION ALL SELECT b, a FROM matches),
    reach(id, seen) AS (SELECT DISTINCT a, a FROM links UNION SELECT id, b FROM reach JOIN links ON seen = a),
    clusters AS (SELECT id AS p_partkey, min(seen) AS cluster_id FROM reach GROUP BY 1)"""

# Rows c with the rank r of their key, paired within a rank and with the next one.
NEIGHBOURS = """c a CROSS JOIN (VALUES (0), (1)) AS s(d) JOIN c b ON b.r = a.r + d
      WHERE (d = 1 OR a.c_custkey < b.c_custkey)"""

THRESHOLD = f"""{PART_PAIRS}, matches AS (SELECT a, b FROM pairs WHERE (s0 + s1 + s2) / 3 >= 0.6 - 1e-9), {COMPONENTS}"""


def _vectors(found):
    vectors = similarity_vectors(found)
    names = [c for c in vectors.columns if c != "pair_count"]
    return vectors.withColumns({n: F.round(n, 6) for n in names})


def _part_clusters(t):
    return link.find_clusters(t.part, "p_partkey", BLOCK, ignore=BLOCK, threshold=0.6)


@query("dedup_blocks", """
    SELECT p_name, p_brand, count(*) AS row_count, (count(*) * (count(*) - 1) // 2)::BIGINT AS pair_count
    FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def dedup_blocks(t):
    return cand.blocks(t.part, BLOCK)


@query("dedup_neighbourhoods", """
    WITH n AS (SELECT c_acctbal AS value, count(*) AS row_count FROM customer GROUP BY 1)
    SELECT value, row_count, lead(value) OVER (ORDER BY value) AS next_value,
      (row_count * (row_count - 1) // 2
        + row_count * coalesce(lead(row_count) OVER (ORDER BY value), 0))::BIGINT AS pair_count FROM n""")
def dedup_neighbourhoods(t):
    return cand.neighbourhoods(t.customer, "c_acctbal")


@query("dedup_similarity", f"""
    WITH {PART_PAIRS} SELECT round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, count(*) AS pair_count
    FROM pairs GROUP BY 1, 2, 3""")
def dedup_similarity(t):
    return _vectors(cand.candidates(t.part, "p_partkey", BLOCK, ignore=BLOCK))


@query("dedup_similarity_neighbours", f"""
    WITH c AS (SELECT *, dense_rank() OVER (ORDER BY c_acctbal) AS r FROM customer),
    pairs AS (SELECT {_similar('a.c_name', 'b.c_name')} AS s0,
        {_similar('a.c_nationkey::VARCHAR', 'b.c_nationkey::VARCHAR')} AS s1,
        {_similar('a.c_acctbal::VARCHAR', 'b.c_acctbal::VARCHAR')} AS s2,
        {_similar('a.c_mktsegment', 'b.c_mktsegment')} AS s3
      FROM {NEIGHBOURS})
    SELECT round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3, count(*) AS pair_count
    FROM pairs GROUP BY 1, 2, 3, 4""")
def dedup_similarity_neighbours(t):
    return _vectors(cand.candidates(t.customer, "c_custkey", ["c_acctbal"]))


PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]

ALL_PAIRS = f"""pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b,
      {", ".join(f"{_similar(f'a.{c}::VARCHAR', f'b.{c}::VARCHAR')} AS s{i}" for i, c in enumerate(PART_COLUMNS))}
    FROM part a JOIN part b ON a.p_partkey < b.p_partkey)"""


@query("dedup_similarity_all", f"""
    WITH {ALL_PAIRS}
    SELECT {", ".join(f"round(s{i}, 6) AS s{i}" for i in range(5))}, count(*) AS pair_count FROM pairs GROUP BY ALL""")
def dedup_similarity_all(t):
    """Every pair of rows in all columns."""
    return _vectors(cand.candidates(t.part, "p_partkey"))


@query("dedup_similarity_prefix", f"""
    WITH pairs AS (SELECT {_similar('a.p_type', 'b.p_type')} AS s0,
        {_similar('a.p_retailprice::VARCHAR', 'b.p_retailprice::VARCHAR')} AS s1
      FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_name[:3] = b.p_name[:3] AND a.p_partkey < b.p_partkey)
    SELECT round(s0, 6) AS s0, round(s1, 6) AS s1, count(*) AS pair_count FROM pairs GROUP BY 1, 2""")
def dedup_similarity_prefix(t):
    """Blocks by a column made for it: the beginning of a name, as the caller's own choice."""
    named = t.part.withColumn("beginning", F.substring("p_name", 1, 3))
    return _vectors(cand.candidates(named, "p_partkey", ["p_size", "beginning"],
                                    ignore=["p_name", "p_brand", "p_size", "beginning"]))


@query("dedup_full_clusters", f"""
    WITH RECURSIVE {ALL_PAIRS}, matches AS (SELECT a, b FROM pairs WHERE (s0 + s1 + s2 + s3 + s4) / 5 >= 0.8 - 1e-9),
    {COMPONENTS} SELECT * FROM clusters""")
def dedup_full_clusters(t):
    return link.find_clusters(t.part, "p_partkey", threshold=0.8)


DOCUMENT_KEYS = ["lang", "source"]


@query("dedup_documents", f"""
    WITH RECURSIVE c AS (SELECT *, n_chars // 100 AS size FROM documents),
    matches AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b
      ON a.lang = b.lang AND a.source = b.source AND a.size = b.size AND a.doc_id < b.doc_id
      WHERE {_similar('a.text', 'b.text')} >= 0.7 - 1e-9), {COMPONENTS}
    SELECT p_partkey AS doc_id, cluster_id FROM clusters""")
def dedup_documents(t):
    """Whole texts of thousands of characters, compared within blocks of one language, source and size."""
    rows = t.documents.withColumn("size", F.expr("n_chars div 100"))
    keys = [*DOCUMENT_KEYS, "size"]
    return link.find_clusters(rows, "doc_id", keys, ignore=[*keys, "n_chars"], threshold=0.7)


@query("dedup_documents_openings", f"""
    WITH RECURSIVE c AS (SELECT *, substr(text, 1, 24) AS opening FROM documents),
    matches AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b
      ON a.lang = b.lang AND a.opening = b.opening AND a.doc_id < b.doc_id
      WHERE {_similar('a.text', 'b.text')} >= 0.8 - 1e-9), {COMPONENTS}
    SELECT p_partkey AS doc_id, cluster_id FROM clusters""")
def dedup_documents_openings(t):
    """Whole texts of any source and length that begin alike."""
    rows = t.documents.withColumn("opening", F.substring("text", 1, 24))
    return link.find_clusters(rows, "doc_id", ["lang", "opening"], ignore=["lang", "opening", "source", "n_chars"],
                              threshold=0.8)


@query("dedup_clusters", f"WITH RECURSIVE {THRESHOLD} SELECT * FROM clusters")
def dedup_clusters(t):
    return _part_clusters(t)


CLOSER = """(s0 - h0) ** 2 + (s1 - h1) ** 2 + (s2 - h2) ** 2 < (s0 - l0) ** 2 + (s1 - l1) ** 2 + (s2 - l2) ** 2"""


@query("dedup_kmeans", f"""
    WITH RECURSIVE {PART_PAIRS},
    rounds(i, l0, l1, l2, h0, h1, h2) AS (
      SELECT 0, 0.05::DOUBLE, 0.05::DOUBLE, 0.05::DOUBLE, 0.95::DOUBLE, 0.95::DOUBLE, 0.95::DOUBLE
      UNION ALL
      SELECT i + 1, avg(s0) FILTER (NOT m), avg(s1) FILTER (NOT m), avg(s2) FILTER (NOT m),
        avg(s0) FILTER (m), avg(s1) FILTER (m), avg(s2) FILTER (m)
      FROM (SELECT *, {CLOSER} AS m FROM rounds, pairs) WHERE i < 30 GROUP BY i),
    matches AS (SELECT a, b FROM pairs, (SELECT * FROM rounds WHERE i = 30) WHERE {CLOSER}), {COMPONENTS}
    SELECT * FROM clusters""")
def dedup_kmeans(t):
    return link.find_clusters(t.part, "p_partkey", BLOCK, ignore=BLOCK)


@query("dedup_clusters_neighbours", f"""
    WITH RECURSIVE c AS (SELECT *, dense_rank() OVER (ORDER BY c_acctbal) AS r FROM customer),
    matches AS (SELECT a.c_custkey AS a, b.c_custkey AS b
      FROM {NEIGHBOURS} AND ({_similar('a.c_name', 'b.c_name')} + {_similar('a.c_nationkey::VARCHAR', 'b.c_nationkey::VARCHAR')}
        + {_similar('a.c_acctbal::VARCHAR', 'b.c_acctbal::VARCHAR')}
        + {_similar('a.c_mktsegment', 'b.c_mktsegment')}) / 4 >= 0.75 - 1e-9),
    {COMPONENTS} SELECT p_partkey AS c_custkey, cluster_id FROM clusters""")
def dedup_clusters_neighbours(t):
    return link.find_clusters(t.customer, "c_custkey", ["c_acctbal"], threshold=0.75)


@query("dedup_review", f"WITH RECURSIVE {THRESHOLD} SELECT cluster_id, part.* FROM clusters JOIN part USING (p_partkey)")
def dedup_review(t):
    return link.review_rows(t.part, "p_partkey", _part_clusters(t))


@query("dedup_apply", f"""
    WITH RECURSIVE {THRESHOLD}
    SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM clusters WHERE p_partkey <> cluster_id)""")
def dedup_apply(t):
    return link.deduplicate(t.part, "p_partkey", BLOCK, ignore=BLOCK, threshold=0.6)


@query("dedup_keep_chosen", f"""
    WITH RECURSIVE {THRESHOLD}, chosen AS (SELECT cluster_id, max(p_partkey) AS keep FROM clusters GROUP BY 1)
    SELECT * FROM part WHERE p_partkey NOT IN (
      SELECT p_partkey FROM clusters JOIN chosen USING (cluster_id) WHERE p_partkey <> keep)""")
def dedup_keep_chosen(t):
    found = _part_clusters(t)
    keep = found.groupBy("cluster_id").agg(F.max("p_partkey").alias("keep_row_id"))
    return link.remove_rows(t.part, "p_partkey", link.rows_to_remove(found, "p_partkey", keep))


@query("dedup_yes_from", f"""
    WITH RECURSIVE {THRESHOLD}
    SELECT * FROM part WHERE p_partkey NOT IN (
      SELECT p_partkey FROM clusters WHERE p_partkey <> cluster_id AND cluster_id >= 300)""")
def dedup_yes_from(t):
    found = _part_clusters(t)
    return link.remove_rows(t.part, "p_partkey", link.rows_to_remove(found, "p_partkey", yes_from=300))


@query("dedup_replay", """
    SELECT p_name, p_brand FROM part EXCEPT ALL SELECT p_name, p_brand FROM part WHERE p_size > 25""")
def dedup_replay(t):
    return link.redo_removal(t.part.select("p_name", "p_brand"), t.part.where("p_size > 25").select("p_name", "p_brand"))


@query("dedup_replay_many_copies", """
    SELECT l_returnflag, nullif(l_linenumber, 3) AS n FROM lineitem
    EXCEPT ALL SELECT l_returnflag, nullif(l_linenumber, 3) FROM lineitem WHERE l_quantity > 40""")
def dedup_replay_many_copies(t):
    def few(df):
        return df.select("l_returnflag", F.nullif("l_linenumber", F.lit(3)).alias("n"))

    return link.redo_removal(few(t.lineitem), few(t.lineitem.where("l_quantity > 40")))
