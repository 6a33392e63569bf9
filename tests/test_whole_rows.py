"""No operator loses rows: null keys, labels and regions, classes and scores beyond the expected ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.operators import address as ad
from bizlens.operators import features as feat
from bizlens.operators import joins as jn
from bizlens.operators import metrics as mt
from bizlens.operators import models as md
from bizlens.operators import paging as pg
from bizlens.operators import sampling as sp
from bizlens.operators import summaries as sm
from bizlens.sources.licences import licences
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def gaps(spark):
    """20 rows, 4 without a key, 5 without a label, one null stratum."""
    rows = [(None if k % 5 == 0 else k, "s" if k % 3 else None, None if k % 4 == 0 else k % 2) for k in range(20)]
    return spark.createDataFrame(rows, "unique_id long, s string, y int")


def test_sampling_returns_every_row(gaps):
    for out in (sp.stratified_split(gaps, ["s", "y"], 0.3, "unique_id"), sp.sample_to(gaps, ["y"], 10, "unique_id"),
                sp.undersample(gaps, "y", "unique_id"), sp.dense_index(gaps, "unique_id", 1)):
        assert out.count() == 20
    train, test = sp.split(gaps, ["y"], 0.3, "unique_id")
    assert train.count() + test.count() == 20


def test_sampling_is_exact_without_broadcast(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("unique_id"), (F.col("id") % 7).alias("y"))
    want = {r["unique_id"] for r in sp.sample_to(df, ["y"], 700, "unique_id").where("sampled").collect()}
    assert len(want) == 700
    monkeypatch.setattr(sp, "BROADCAST_STRATA", 3)
    assert {r["unique_id"] for r in sp.sample_to(df, ["y"], 700, "unique_id").where("sampled").collect()} == want


def test_sampling_plan_has_no_shuffle_of_the_base(spark):
    df = spark.range(1000).select(F.col("id").alias("unique_id"), (F.col("id") % 3).alias("y"))
    plan = sp.sample_to(df, ["y"], 100, "unique_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_paging_numbers_null_keys_first(gaps):
    rows = pg.global_index(gaps, "unique_id", buckets=4).collect()
    assert sorted(r["idx"] for r in rows) == list(range(20))
    assert all(r["idx"] < 4 for r in rows if r["unique_id"] is None)


def test_paging_orders_any_key(spark):
    """Text keys, composite keys, integers beyond 2**53 and a key of half the rows, split over ranges."""
    big = 1 << 60
    rows = [(f"k{k % 7}" if k % 2 else "hot", big + k, None if k % 11 == 0 else k % 5) for k in range(600)]
    df = spark.createDataFrame(rows, "t string, b bigint, c int")
    assert [r["b"] for r in pg.global_index(df, "b", buckets=5).orderBy("idx").collect()] == [big + k for k in range(600)]
    got = [(r["t"], r["c"], r["b"]) for r in pg.global_index(df, ["t", "c", "b"], buckets=9).orderBy("idx").collect()]
    assert got == sorted(((t, c, b) for t, b, c in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    hot = pg.global_index(df, "t", buckets=6)
    assert [r["t"] for r in hot.orderBy("idx").collect()] == sorted(r[0] for r in rows)
    assert sorted(r["idx"] for r in hot.collect()) == list(range(600))


def test_paging_keeps_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "x", 1), (1, "y", 2)], "part int, row string, idx int")
    assert [(r["part"], r["row"], r["idx"]) for r in pg.global_index(df, "part").orderBy("idx").collect()] == [(1, "y", 0), (3, "x", 1)]
    assert pg.assign_batches(df.limit(0), "part").collect() == []


def test_oversample_keeps_unlabelled_rows(gaps):
    out = sp.oversample(gaps, "y", "unique_id", keep_originals=True)
    assert out.where("draw IS NULL").count() == 20 and out.where("y IS NULL AND draw IS NULL").count() == 5


def test_draws_reach_beyond_32_bits(spark):
    from bizlens.functions.hashing import seeded_hash
    assert spark.range(200).select(F.max(seeded_hash("id", 1))).first()[0] > 1 << 50


def test_confusion_counts_every_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (3, 1), (1, None)], "y int, p int")
    got = {r["label"]: r.asDict() for r in mt.confusion_matrix(df, "y", "p", (0, 1, 2)).collect()}
    assert got[0]["pred_2"] == 1 and got[2] == {"label": 2, "pred_0": 0, "pred_1": 0, "pred_2": 0, "pred_other": 0}
    assert got[3]["pred_1"] == 1 and got[1]["pred_other"] == 1
    free = mt.confusion_matrix(df, "y", "p")
    assert free.columns == ["label", "pred_0", "pred_1", "pred_2", "pred_3", "pred_other"]
    assert sum(v for r in free.collect() for c, v in r.asDict().items() if c != "label") == 5


def test_unlabelled_rows_count_for_no_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.5), (1, None)], "y int, p double")
    assert tuple(mt.roc_auc(df, "y", "p").first()) == (1.0, 1, 1)


def test_scores_within_a_millionth(spark):
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("y"), (F.lit(0.5) + F.col("id") * 1e-10).alias("p"))
    r = mt.roc_auc(df, "y", "p").first()
    assert abs(r["auc"] - (0.5 + 0.5 / 1500)) < 1e-9
    per = mt.score_counts(df, "y", "p").groupBy("_b").count().agg(F.max("count")).first()[0]
    assert per <= 30
    assert mt.roc_curve(df, "y", "p", max_points=50).count() <= 51


def test_precision_recall_has_every_score(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3), (1, 0.4)], "y int, p double")
    assert mt.pr_curve(df, "y", "p").count() == 5
    assert mt.pr_curve(df, "y", "p", until_full_recall=True).count() == 3


def test_class_report_has_two_exchanges(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int")
    out = mt.classification_report(df, "y", "p")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert {r["label"] for r in out.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_region_of_every_licence(spark):
    lic = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    s = spark.createDataFrame([(1, "a", "b", "c")], "id long, sido string, sigungu string, dong string")
    k = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z")], s.schema)
    got = {r["id"]: (r["sido"], r["region_source"]) for r in jn.merge_region(lic, s, k, "id").collect()}
    assert got == {1: ("a", "spatial"), 2: ("x", "lookup"), 3: (None, None)}


def test_payload_without_envelope_is_a_miss(spark):
    df = spark.createDataFrame([("1", '{"results":{"juso":[{"siNm":"A"}]}}'), ("2", '{"results":{"common":{"totalCount":"1"},"juso":[{"siNm":"B"},{"siNm":"C"}]}}')], "uid string, payload string")
    assert [r["siNm"] for r in ad.parse_address_response(df, "payload", ["uid"]).collect()] == ["B", "C"]


def test_enrichment_keeps_null_keys_and_tells_errors(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("error", T.StringType())])

    def fn(pdf):
        raise ValueError("no service")

    df = spark.createDataFrame([("a",), (None,)], "k string")
    got = ad.bulk_enrich(df, fn, schema, ["k"], error_col="error").collect()
    assert {r["k"] for r in got} == {"a", None} and all("no service" in r["error"] for r in got)


def test_quarter_gaps_are_no_change(spark):
    df = spark.createDataFrame([("s", dt.date(2020, 1, 5)), ("s", dt.date(2020, 11, 5)), ("s", dt.date(2021, 2, 1))], "s string, d date")
    got = [(r["quarter"].month, r["prev_value"]) for r in sm.quarterly_trend(df, ["s"], "d").orderBy("quarter").collect()]
    assert got == [(1, None), (10, None), (1, 1)]


def test_long_array_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    assert feat.flatten_array(df, "a", "a_", 3).count() == 1
    with pytest.raises(Exception, match="more than 2 elements"):
        feat.flatten_array(df, "a", "a_", 2).collect()


def test_row_local_queries_do_not_shuffle(spark):
    from bizlens.plans import registry
    for name in ("clean_name", "window_filter", "scan_licences"):
        plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(unique_id" not in plan and "REPARTITION" not in plan
    assert licences(spark, SF_SMALL, by_key=True).count() == licences(spark, SF_SMALL).count()


def test_training_partitions_do_not_follow_the_machine(spark):
    df = spark.range(500).select(F.col("id").alias("unique_id"))
    a = md.training_input(df.repartition(3)).select("unique_id", F.spark_partition_id().alias("p")).collect()
    b = md.training_input(df.repartition(11)).select("unique_id", F.spark_partition_id().alias("p")).collect()
    assert a == b and len({r["p"] for r in a}) == md.TRAIN_PARTITIONS
