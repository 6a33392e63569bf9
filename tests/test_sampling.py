"""Sampling properties: exact quotas, partition independence, complement, balance."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bizlens.operators import sampling as sp


def _data(spark, n=3000, parts=4):
    return (spark.range(n).select(F.col("id").alias("unique_id"),
                                  (F.col("id") % 3).cast("string").alias("s"),
                                  F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("y"))
            .repartition(parts))


def test_split_exact_and_partition_independent(spark):
    a = sp.stratified_split(_data(spark, parts=1), ["s", "y"], 0.1, "unique_id", 42)
    b = sp.stratified_split(_data(spark, parts=7), ["s", "y"], 0.1, "unique_id", 42)
    ta = sorted(r.unique_id for r in a.where("is_test").collect())
    tb = sorted(r.unique_id for r in b.where("is_test").collect())
    assert ta == tb
    counts = {(r.s, r.y): (r.t, r.n) for r in a.groupBy("s", "y").agg(
        F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()}
    for (t, n) in counts.values():
        assert t == int(0.1 * n + 0.5)
    assert a.count() == 3000


def test_split_is_a_partition(spark):
    df = _data(spark)
    train, test = sp.split(df, ["s", "y"], 0.2, "unique_id", 1)
    tr = {r.unique_id for r in train.collect()}
    te = {r.unique_id for r in test.collect()}
    assert not tr & te and len(tr | te) == 3000


def test_sample_to_and_undersample(spark):
    df = _data(spark)
    s = sp.sample_to(df, ["y"], 600, "unique_id", 5).where("sampled")
    by = {r.y: r["count"] for r in s.groupBy("y").count().collect()}
    n1 = df.where("y = 1").count()
    assert by[1] == round(600 * n1 / 3000) and by[0] == round(600 * (3000 - n1) / 3000)
    u = sp.undersample(df, "y", "unique_id", 5).where("kept")
    by = {r.y: r["count"] for r in u.groupBy("y").count().collect()}
    assert by[0] == by[1] == n1


def test_oversample_balances(spark):
    df = _data(spark)
    n1 = df.where("y = 1").count()
    boot = sp.oversample(df, "y", "unique_id", 3, keep_originals=False)
    by = {r.y: r["count"] for r in boot.groupBy("y").count().collect()}
    assert by[0] == by[1] == 3000 - n1
    keep = sp.oversample(df, "y", "unique_id", 3, keep_originals=True)
    by = {r.y: r["count"] for r in keep.groupBy("y").count().collect()}
    assert by[0] == by[1] == 3000 - n1
    originals = {r.unique_id for r in keep.where("y = 1 AND draw IS NULL").collect()}
    assert len(originals) == n1
    # repeatable: same seed, same draws
    again = sp.oversample(df.repartition(2), "y", "unique_id", 3, keep_originals=False)
    assert sorted(map(tuple, boot.collect())) == sorted(map(tuple, again.collect()))


def test_dense_index_is_a_permutation(spark):
    idx = sp.dense_index(_data(spark), "unique_id", 9, "i")
    vals = sorted(r.i for r in idx.collect())
    assert vals == list(range(3000))


def test_class_weights(spark):
    df = _data(spark)
    w = {r.y: r.weight for r in sp.class_weights(df, "y").collect()}
    n1 = df.where("y = 1").count()
    assert abs(w[1] - 3000 / (2 * n1)) < 1e-12 and abs(w[0] - 3000 / (2 * (3000 - n1))) < 1e-12


def _hash(key, seed):
    return int(hashlib.md5(f"{'' if key is None else key}|{seed}".encode()).hexdigest()[:15], 16)


def _smallest(rows, quota, seed):
    """Brute force: rows (key, stratum) whose (hash, key) is not above that of row k of their stratum."""
    strata = defaultdict(list)
    for key, s in rows:
        strata[s].append((_hash(key, seed), key is not None, key or 0))
    sizes = {s: len(r) for s, r in strata.items()}
    out = []
    for s, r in strata.items():
        k = min(quota(sizes[s], len(rows), min(sizes.values())), sizes[s])
        top = sorted(r)[k - 1] if k else None
        out += [(s, x[2] if x[1] else None) for x in r if k and x <= top]
    return sorted(out, key=str)


@pytest.mark.parametrize("reach", [sp.SKETCH_REACH, 0.0])
def test_smallest_rows_match_brute_force(spark, monkeypatch, reach):
    # a hot stratum, a null one, keys that repeat and null keys; without reach most brackets miss and are listed whole
    monkeypatch.setattr(sp, "SKETCH_REACH", reach)
    monkeypatch.setattr(sp, "SKETCH_K", 16 if reach == 0.0 else sp.SKETCH_K)
    rows = [(None if i % 301 == 0 else i // (1 + (i % 50 == 0)), "hot" if i % 3 else (None if i % 7 == 0 else f"s{i % 5}")) for i in range(9000)]
    df = spark.createDataFrame(rows, "unique_id long, s string").repartition(5)
    got = sp.select_smallest(df, ["s"], lambda n, N, m: F.round(n * 0.25), "unique_id", 11).where("selected")
    assert sorted([(r.s, r.unique_id) for r in got.collect()], key=str) == _smallest(rows, lambda n, N, m: int(0.25 * n + 0.5), 11)


def test_smallest_rows_of_many_strata_are_joined(spark, monkeypatch):
    monkeypatch.setattr(sp, "BROADCAST_STRATA", 3)
    rows = [(i, str(i % 40)) for i in range(4000)]
    got = sp.select_smallest(spark.createDataFrame(rows, "unique_id long, s string"), ["s"], lambda n, N, m: F.lit(7), "unique_id", 2)
    assert got.count() == 4000
    assert sorted([(r.s, r.unique_id) for r in got.where("selected").collect()], key=str) == _smallest(rows, lambda n, N, m: 7, 2)


def test_smallest_rows_without_strata_or_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "unique_id")
    assert sp.select_smallest(df, [], lambda n, N, m: F.lit(9), "unique_id", 1).where("selected").count() == 9
    assert sp.select_smallest(df.limit(0), [], lambda n, N, m: F.lit(9), "unique_id", 1).collect() == []
    assert sp.stratified_split(_data(spark).limit(0), ["s"], 0.1, "unique_id").collect() == []


def test_base_is_read_three_times_and_never_shuffled(spark):
    """Two scans to find the thresholds, one that compares: the accumulator counts every evaluation of a row."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _data(spark).mapInArrow(count, "unique_id long, s string, y int")
    out = sp.stratified_split(df, ["s", "y"], 0.1, "unique_id", 42)
    assert seen.value <= 2 * 3000
    out.collect()
    assert seen.value <= 3 * 3000
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_split_and_sample_equals_split_then_sample(spark):
    """Selections made on narrow rows give the rows of split and sample_to; a null and a repeated key among them."""
    df = spark.range(4000).select(F.when(F.col("id") == 7, None).when(F.col("id") == 8, 9).otherwise(F.col("id")).alias("unique_id"),
                                  (F.col("id") % 3).cast("string").alias("service"), (F.col("id") % 5 == 0).cast("int").alias("closed")).repartition(4)
    wide = df.withColumn("feature", F.col("unique_id") / 2)
    sample, test = sp.split_and_sample(wide, ["service", "closed"], 0.1, ["closed"], 100, "unique_id", 5, 6)
    train, want = sp.split(wide, ["service", "closed"], 0.1, "unique_id", 5)
    drawn = sp.sample_to(train, ["closed"], 100, "unique_id", 6).where("sampled").drop("sampled")
    for got, expected in ((sample, drawn), (test, want)):
        rows = sorted(map(str, got.collect()))
        assert len(rows) >= 100 and rows == sorted(map(str, expected.collect())) and got.columns == wide.columns
