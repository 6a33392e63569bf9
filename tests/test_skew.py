"""Hot keys (a third of all rows on one value) keep results whole and exact."""
from pyspark.sql import functions as F

from bizlens.operators import address as ad
from bizlens.operators import features as feat
from bizlens.operators import sampling as sp


def _hot(spark, n=6000):
    # every third row shares the same stratum / name / key
    return spark.range(n).select(
        F.col("id").alias("unique_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("n"), (F.col("id") % 97).cast("string")))
        .alias("clean_name"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"))


def test_hot_stratum_split_is_exact(spark):
    df = _hot(spark)
    out = sp.stratified_split(df, ["clean_name"], 0.25, "unique_id", 3)
    assert out.count() == 6000
    hot = out.where("clean_name = 'HOT'")
    assert hot.where("is_test").count() == round(0.25 * 2000)


def test_hot_name_franchise_flag(spark):
    df = _hot(spark)
    flags = feat.franchise_flag(df, min_count=1000)
    assert flags.count() == 6000
    assert {r.is_franchise for r in flags.where(F.col("unique_id") % 3 == 0).collect()} == {1}
    assert flags.where(F.col("unique_id") % 3 != 0).agg(F.sum("is_franchise")).first()[0] == 0


def test_hot_key_dedup(spark):
    df = _hot(spark).select(F.col("clean_name").alias("uid"), F.lit("a").alias("addr"),
                            F.col("unique_id").alias("ord"))
    out = {r.uid: r.ord for r in ad.dedup_first(df, ["uid", "addr"], "ord").collect()}
    assert out["HOT"] == 0 and len(out) == 98
