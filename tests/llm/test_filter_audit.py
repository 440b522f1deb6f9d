import re
from itertools import permutations

import helpers
import numpy as np
from pyspark.sql import functions as F

from tablewash.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(documents, labels):
    """All numbers by applying the filters one by one to each document."""
    rows = [(d, s or "", t or "") for d, t, _, s, _ in documents]
    docs = []
    for doc, part, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc is not None and any(o is not None and o < doc and t == text for o, _, t in rows)}
        marks = [(q, x) for d, q, x in labels if d is not None and d == doc]
        docs.append((part, {f for f in fails if fails[f]}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    result = []
    for part in {p for p, *_ in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        gone, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                gone[f] += len(out)
                lines.append((part, "".join(order), step, len(left), len(out), sum(f in d[0] for d in mine) - len(out),
                              sum(d[0] == {f} for d in mine), sum(d[1] for d in out), sum(d[2] for d in out), f))
        result += [(*line[:-1], gone[line[-1]]) for line in lines]
    return sorted(result, key=repr)


def documents_of_all_kinds():
    rows = list(helpers.edge_rows())
    for n in range(60):
        text = helpers.sentence(n % 23, 150 + 7 * n % 130, 90 if n % 3 else 4000)
        text += " Loud WORDS AND MORE OF THEM" * (n % 4) + " $" * (n % 5 == 0)
        rows.append((100 + n, text, "en", [None, "", "a", "b", "hot", "hot"][n % 6], len(text)))
    rows += [(9, rows[-1][1], "en", "hot", 1), (500, rows[-1][1], "en", "b", 1), (500, rows[-1][1], "en", "b", 1),
             (500, "one id, another text", "en", "b", 1), (None, rows[-1][1], "en", "a", 1)]
    return rows


def test_against_brute_force(spark):
    documents = documents_of_all_kinds()
    labels = [(n, n % 2, n % 7 == 0 and 1 or 0) for n in range(90, 140)] + [
        (1, 1, None), (1, 0, 1), (None, 1, 1), (500, None, 1), (9999, 1, 1), (2, 2, 2)]
    table = helpers.clashing(spark.createDataFrame(documents, helpers.SCHEMA).repartition(5)).withColumn(
        "mask", F.lit("own")).withColumn("docs", F.lit("own"))
    found = filter_audit.audit(filter_audit.failure_cells(table, spark.createDataFrame(labels, LABELS)))
    assert helpers.rows(found) == brute(documents, labels)


def test_empty(spark):
    none = filter_audit.failure_cells(spark.createDataFrame([], helpers.SCHEMA), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(none).count() == 0


def test_walk_toggles_one_filter_at_a_time():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 50, (16, 3))
    states = filter_audit.walk(cells, 4)
    for subset in range(16):
        assert (states[subset] == cells[[m for m in range(16) if not m & subset]].sum(axis=0)).all()


def test_other_filters(spark):
    """The walk takes any conditions; two of them and the one for repeated texts have six orders of three."""
    table = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "bb", "s"), (4, "cc", None)],
                                  "doc_id long, text string, source string")
    cells = filter_audit.failure_cells(table, spark.createDataFrame([], LABELS), {
        "short": F.length("text") < 2, "b": F.col("text").contains("b")})
    found = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(cells, "SBE").collect()}
    assert len(found) == 2 * 6 * 3
    assert found["s", "SBE", 1] == (1, 2, 0, 1, 0, 0, 3 * 2 + 3 - 3 + 3 * 0 + 3 * 1)
    assert found["s", "ESB", 1][:4] == (2, 1, 0, 0)
    assert found["", "SBE", 3][:4] == (1, 0, 0, 0)
