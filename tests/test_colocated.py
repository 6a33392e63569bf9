"""Tables in buckets of one key (S3): joins without a shuffle, the same rows."""
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from bizlens.operators import joins as jn
from bizlens.operators import sampling as sp
from bizlens.sources import tables as tb


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def save(df, key="k", buckets=None):
    name = f"co_{uuid.uuid4().hex}"
    return tb.write_colocated(df, name, key, path=f"{tempfile.mkdtemp(prefix='bizlens-co-')}/{name}", buckets=buckets)


def test_joins_of_colocated_tables_move_no_row(spark, no_broadcast):
    names = spark.range(2000).selectExpr("nullif(id, 7) AS k", "concat('n', id % 50) AS name")
    flags = spark.range(0, 2000, 3).selectExpr("id AS k", "1 AS is_franchise")
    vectors = spark.range(0, 2000, 5).selectExpr("id AS k", "CAST(id AS float) AS embedding_0", "CAST(-id AS float) AS embedding_1")

    def joined(a, b, c):
        return jn.left_join_prefix(jn.left_join_default(a, b, "k", {"is_franchise": 0}), c, "k", "embedding_", 0.0)

    a, b, c = save(names), save(flags), save(vectors)
    out = joined(a, b, c)
    assert "Exchange" not in plan(out)
    assert sorted(map(str, out.collect())) == sorted(map(str, joined(names, flags, vectors).collect()))
    assert "Exchange" in plan(joined(names, flags, vectors))
    rest = jn.complement(a, b, "k")
    assert "Exchange" not in plan(rest) and rest.count() == jn.complement(names, flags, "k").count()
    per = a.groupBy("k").count()
    assert "Exchange" not in plan(per)


def test_a_bucket_is_one_file_and_empty_tables_are_tables(spark):
    a = save(spark.range(500).withColumnRenamed("id", "k").repartition(6), buckets=4)
    assert len(a.inputFiles()) == 4 and a.count() == 500
    assert save(spark.range(0).withColumnRenamed("id", "k")).count() == 0


def test_overlay_refuses_a_repeated_key(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, None)], "k int, v string")
    once = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (None, "z"), (9, "q"), (9, "r")], "k int, w string")
    got = {(r["k"], r["v"]) for r in jn.overlay(a, once, "k", {"v": "w"}).collect()}
    assert got == {(1, "x"), (2, "b"), (None, "c"), (4, None)}  # a repeated key that no row of a asks for is of no concern
    with pytest.raises(Exception, match="repeated key 1"):
        jn.overlay(a, once.union(spark.createDataFrame([(1, "x2")], "k int, w string")), "k", {"v": "w"}).collect()


def test_shuffle_rows_depends_on_key_and_seed_only(spark):
    ids = lambda df: [r["k"] for r in df.collect()]
    base = spark.range(300).withColumnRenamed("id", "k")
    one = ids(sp.shuffle_rows(base, "k", 5))
    assert one == ids(sp.shuffle_rows(base.orderBy(F.desc("k")).repartition(5), "k", 5))
    assert one != ids(sp.shuffle_rows(base, "k", 6)) and sorted(one) == list(range(300))
