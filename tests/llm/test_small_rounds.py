"""Rounds over few rows take few tasks and leave nothing behind, whatever the number of shuffle partitions."""

import os
import random

import pytest
from bizlens.llm.near_dup import components, drop_near_duplicates
from bizlens.llm.packing import pack
from bizlens.session import ensure_checkpoint_dir
from llm_cases import make_docs, vocabulary_words

PARTITIONS = 150


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(spark):
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


def test_components(spark, many_partitions):
    before = written(spark)
    label = components(spark.createDataFrame([(i + 1, i) for i in range(60) if i % 20 != 19], "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in label.collect()} == {i: i // 20 * 20 for i in range(60)}
    assert len(label.inputFiles()) == 1 and len(written(spark) - before) == 1


def test_near_duplicates_leave_the_groups_only(spark):
    rnd, vocab = random.Random(3), vocabulary_words()
    base = [[rnd.choice(vocab) for _ in range(80)] for _ in range(3)]
    rows = [(10 * g + k, " ".join(w[:78] + [f"end{k}"] * (2 if k else 0)), "s") for g, w in enumerate(base) for k in range(6)]
    before = written(spark)
    left = drop_near_duplicates(make_docs(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {0, 10, 20}
    assert [d.rsplit("-", 1)[0] for d in written(spark) - before] == ["groups"]


def test_pack(spark, many_partitions):
    rnd = random.Random(4)
    sizes = {i: rnd.randint(1, 100) for i in range(400)}
    out = pack(spark.createDataFrame(list(sizes.items()), "id bigint, size bigint").coalesce(1), limit=100, range_rows=60)
    assert out.rdd.getNumPartitions() < PARTITIONS
    by = {}
    rows = out.collect()
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["id"]]))
    assert sorted(r["id"] for r in rows) == sorted(sizes)
    for own in by.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
