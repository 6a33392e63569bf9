"""Texts that a join on doc_id cannot match stay out of its shuffle; the join stays exact."""

import random

import pytest
from bizlens.llm import common
from bizlens.llm.near_dup import class_sets, drop_near_duplicates, near_duplicates, signatures
from llm_cases import make_docs, vocabulary_words
from pyspark.sql import functions as F


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def texts_dealt(df):
    """Rows with a text that the shuffles of ``df`` wrote, as it ran."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and "text#" in node.output().mkString(","):
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def some_docs(spark, n=300, copies=20):
    rnd, vocab = random.Random(8), vocabulary_words()
    rows = [(k, " ".join(rnd.choice(vocab) for _ in range(60)), "s") for k in range(n)]
    return make_docs(spark, rows + [(n + k, rows[k][1] + " end", "s") for k in range(copies)])


@pytest.mark.parametrize("most", [common.FILTER_BITS, 1 << 8])
def test_key_filter(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FILTER_BITS", most)
    keys = [(i * 7919 - 10 ** 6,) for i in range(1000)] + [(2 ** 63 - 1,), (-2 ** 63,), (None,), (5,), (5,)]
    test = common.key_filter(spark.createDataFrame(keys, "k bigint"), "k")
    holds = lambda c: common.in_filter(test, c)
    assert all(r[0] for r in spark.createDataFrame(keys, "k bigint").select(holds(F.col("k"))).collect())
    if most > 1 << 8:
        others = spark.range(10 ** 8, 10 ** 8 + 5000).where(holds(F.col("id"))).count()
        assert others < 100
    none = common.key_filter(spark.createDataFrame([], "k bigint"), "k")
    assert spark.createDataFrame(keys, "k bigint").where(common.in_filter(none, F.col("k"))).count() == 0


@pytest.mark.parametrize("most", [common.FILTER_BITS, 1 << 6])
def test_removal_deals_few_texts(spark, no_broadcast, monkeypatch, most):
    monkeypatch.setattr(common, "FILTER_BITS", most)
    docs = some_docs(spark)
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])  # doc_id is not the first column
    left = drop_near_duplicates(docs)
    dealt = texts_dealt(left)
    assert dealt <= (40 if most > 1 << 6 else 320)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, docs.where("doc_id < 300").collect()))


def test_sets_deal_few_texts(spark, no_broadcast):
    docs = some_docs(spark)
    wanted = signatures(docs).where("doc_id < 10").select("doc_id", "cls")
    sets = class_sets(docs, wanted)
    assert texts_dealt(sets) == 0
    assert "ArrowEvalPython" not in sets._jdf.queryExecution().executedPlan().toString()  # one Python worker a task
    assert {bytes(r["cls"]) for r in sets.collect()} == {bytes(r["cls"]) for r in wanted.collect()}


def test_filter_and_text_of_other_rows(spark, no_broadcast):
    """Ids of another whole type and null texts go through the filter like others."""
    docs = some_docs(spark, 40, 5).withColumn("doc_id", F.col("doc_id").cast("int")).withColumn("text", F.when(F.col("doc_id") != 39, F.col("text")))
    assert {r["doc_id"] for r in drop_near_duplicates(docs).collect()} == set(range(40))
    assert near_duplicates(docs).where("NOT kept").count() == 5
