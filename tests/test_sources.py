"""Sinks and schema enforcement (S3-S5, S7, S8): read-back properties."""
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.sources import tables as tb


def test_overwrite_append_rebuild(spark):
    path = tempfile.mkdtemp(prefix="bizlens-sink-") + "/t"
    df = spark.range(10).withColumnRenamed("id", "k")
    tb.write_table(df, path, mode="overwrite")
    tb.write_table(df, path, mode="append")
    assert tb.read_table(spark, path).count() == 20
    tb.rebuild_table(df.limit(3), path)
    assert tb.read_table(spark, path).count() == 3


def test_failed_rebuild_keeps_the_old_rows(spark):
    path = tempfile.mkdtemp(prefix="bizlens-sink-") + "/t"
    tb.rebuild_table(spark.range(10), path)
    broken = spark.range(100).repartition(8).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tb.rebuild_table(broken, path)
    assert tb.read_table(spark, path).count() == 10
    before = set(os.listdir(path))
    tb.rebuild_table(tb.read_table(spark, path).where("id < 4"), path)  # reads what it replaces
    assert tb.read_table(spark, path).count() == 4 and len(before & set(os.listdir(path))) == 2  # the version before stays for its readers
    for k in range(3):
        tb.rebuild_table(spark.range(k + 1), path)
    assert tb.read_table(spark, path).count() == 3 and len([f for f in os.listdir(path) if f.startswith("_version")]) == tb.KEEP
    tb.write_table(spark.range(5), path, mode="append")
    assert tb.read_table(spark, path).count() == 8


def test_rebuild_of_a_named_table(spark):
    name = f"rebuilt_{uuid.uuid4().hex}"
    try:
        tb.rebuild_table(spark.range(10), name)
        assert spark.table(name).count() == 10
        tb.rebuild_table(spark.range(3), name)
        assert tb.read_table(spark, name).count() == 3
        with pytest.raises(Exception):
            tb.rebuild_table(spark.range(9).select(F.when(F.col("id") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")), name)
        with pytest.raises(ValueError):
            tb.rebuild_table(spark.range(3).withColumnRenamed("id", "k"), name)
        assert spark.table(name).count() == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_published_sinks_appear_together(spark):
    root = tempfile.mkdtemp(prefix="bizlens-fan-")
    tb.fan_out_together(spark.range(4).selectExpr("id", "id + 1 AS a"), root, {"bronze": None, "silver": ["a"]})
    broken = spark.range(50).select("id", F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("a"))
    with pytest.raises(Exception, match="lost"):  # the first sink does not read ``a``: it is written whole, and yet not shown
        tb.publish({"bronze": broken.select("id"), "silver": broken.select("a")}, root)
    assert tb.read_table(spark, root, name="bronze").count() == tb.read_table(spark, root, name="silver").count() == 4


def test_fan_out_sinks_agree(spark):
    base = tempfile.mkdtemp(prefix="bizlens-fan-")
    df = spark.range(25).selectExpr("id AS uid", "id * 2 AS a", "'x' AS b")
    tb.fan_out(df, {f"{base}/bronze": None, f"{base}/silver": ["uid", "a"]}, mode="overwrite")
    bronze = spark.read.parquet(f"{base}/bronze")
    silver = spark.read.parquet(f"{base}/silver")
    assert silver.columns == ["uid", "a"] and bronze.columns == ["uid", "a", "b"]
    assert sorted(map(tuple, silver.collect())) == sorted(map(tuple, bronze.select("uid", "a").collect()))


def test_enforce_schema(spark):
    df = spark.createDataFrame([(1, "7", "drop")], "a int, b string, c string")
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.LongType()),
                           T.StructField("z", T.StringType())])
    out = tb.enforce_schema(df, schema)
    assert out.schema.simpleString() == "struct<b:bigint,a:bigint,z:string>"
    assert tuple(out.first()) == (7, 1, None)
    strict = T.StructType([T.StructField("z", T.StringType(), nullable=False)])
    with pytest.raises(Exception):
        tb.enforce_schema(df, strict).collect()
