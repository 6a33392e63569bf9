"""Negative cases: empty inputs, empty dictionary, unseen/null categories."""
from pyspark.sql import functions as F

from bizlens.functions import text as tx
from bizlens.operators import metrics as mt
from bizlens.operators import models as md
from bizlens.operators import names as nm
from bizlens.operators import sampling as sp

SCHEMA = "unique_id long, bizname string"


def test_empty_input_everywhere(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nm.final_name_table(empty, top_n=5, min_freq=1).count() == 0
    spark.catalog.clearCache()
    e2 = spark.createDataFrame([], "unique_id long, s string, y int, p double")
    assert sp.stratified_split(e2, ["s", "y"], 0.1, "unique_id").count() == 0
    assert mt.roc_auc(e2, "y", "p").first().auc is None


def test_empty_dictionary_drops_every_held_row(spark):
    # every name is held, so the dictionary (built from non-held names) is empty
    df = spark.createDataFrame([(1, "김밥천국신촌점"), (2, "GS25역삼점")], SCHEMA)
    stage1 = nm.clean_names(df)
    assert {r.clean_result for r in stage1.collect()} == {tx.HOLD}
    out = nm.resolve_held_names(stage1, top_n=10, min_freq=1)
    assert out.count() == 0
    spark.catalog.clearCache()


def test_null_category_gets_extra_index(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "unique_id long, c string")
    out = {r.unique_id: r.c_index for r in md.label_encode(df, ["c"]).collect()}
    assert out[1] == out[2] == 0 and out[4] == 1 and out[3] == 2


def test_held_name_without_frequent_brand_is_dropped(spark):
    rows = [(i, "이디야") for i in range(3)] + [(10, "홍대이디야점"), (11, "없는가게점")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.unique_id: r.clean_name for r in nm.resolve_held_names(nm.clean_names(df), top_n=5, min_freq=1).collect()}
    assert out[10] == "이디야" and 11 not in out and out[0] == "이디야"
    spark.catalog.clearCache()
