import helpers
import pytest

from tablewash.llm import mixing


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing again what stopped sources leave, as it is told."""
    goal, target, open_ones = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_ones:
        spent = sum(target[i] for i in range(len(sizes)) if i not in open_ones)
        total = sum(weights[i] for i in open_ones)
        for i in open_ones:
            target[i] = (goal - spent) * weights[i] / total
        over = [i for i in open_ones if target[i] >= most * sizes[i]]
        if not over:
            break
        for i in over:
            target[i] = most * sizes[i]
        open_ones = [i for i in open_ones if i not in over]
    return target


def test_targets_and_words_taken(spark):
    rows = [(n, helpers.sentence(n, 5 + n % 40), f"s{n % 7 if n % 3 else 0}") for n in range(2000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(documents).toPandas().merge(documents.toPandas(), on="doc_id")
    by = plan.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"),
                                    real=("size", "sum"))
    assert (by["size"] == by["real"]).all()
    want = level(by["real"].tolist(), [3, 1, 2, 3, 1, 2, 3])
    assert by["target"].tolist() == pytest.approx(want)
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 50).all()
    assert (plan["taken"] <= 2 * plan["size"]).all() and (plan["taken"] % plan["size"] == 0).all()
    again = mixing.mix_plan(documents.repartition(5)).toPandas().set_index("doc_id")["taken"].sort_index()
    assert (again == plan.set_index("doc_id")["taken"].sort_index()).all()


def test_mix_emits_what_the_plan_says(spark):
    documents = helpers.clashing(spark.createDataFrame(
        [(n, helpers.sentence(n, 20), f"s{n % 4}") for n in range(300)], "doc_id long, text string, source string"))
    plan = {r.doc_id: r.taken // r["size"] for r in mixing.mix_plan(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {doc: times for doc, times in plan.items() if times}
    assert mixed.join(documents, documents.columns, "left_anti").count() == 0


def test_edge_rows(spark):
    documents = helpers.edge_documents(spark)
    plan = mixing.mix_plan(documents)
    assert plan.count() == documents.count()
    nulls = plan.where("doc_id in (2, 3, 4)").collect()
    assert all(r["size"] == 0 and r.taken == 0 for r in nulls)
    assert plan.where("target is null or taken is null or target > 2 * source_size").count() == 0
    assert mixing.mix_plan(documents.limit(0)).count() == 0 and mixing.mix(documents.limit(0)).count() == 0
    blank = documents.where("doc_id in (2, 3, 4)")
    assert {r.target for r in mixing.mix_plan(blank).collect()} == {0.0}


def test_sources_in_code_point_order_with_null_last(spark):
    names = ["b", "B", "ä", "a", None, "\U0001F600", "～"]
    documents = spark.createDataFrame([(n, "x " * 1000, name) for n, name in enumerate(names)],
                                      "doc_id long, text string, source string")
    got = {r.doc_id: r.target for r in mixing.mix_plan(documents).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    want = level([1000] * 7, [3, 1, 2, 3, 1, 2, 3])
    assert [got[names.index(n)] for n in order] == pytest.approx(want)


def test_native_plan(spark):
    plan = mixing.mix_plan(helpers.edge_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
