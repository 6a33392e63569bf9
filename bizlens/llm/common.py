"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import ensure_checkpoint_dir, scratch_path

#: A word is a run of anything but ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, read through Spark so that any path Spark opens works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, which cannot be read afterwards; files elsewhere stay."""
    spark = df.sparkSession
    base = scratch_path(spark, "")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        root = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(base))
        if fs.makeQualified(path.getParent()).equals(root):
            fs.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared folder); partitions and their order are kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch of rows that a Python task gets at a time (a longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory of this worker to the system: Spark reuses workers, and what one keeps adds up."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, not rows alone; the worker's memory is given back when a task ends.

    The bound is a setting of the session (Spark reads it when the plan runs); a lower one is left as it is.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
    if not held or int(held[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


#: Bits of a key filter: for each key, and at most (8 MB).
KEY_BITS, FILTER_BITS = 16, 1 << 26


def _places(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Four of ``bits`` (a power of two) places for every 64-bit hash (4 x keys)."""
    h = hashed.astype(np.int64, copy=False).view(np.uint64)
    turns = np.arange(4, dtype=np.uint64)[:, None]
    return (h + turns * (h >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)


def key_hash(column) -> "F.Column":
    """What ``key_filter`` tests, of a column of whole numbers."""
    return F.xxhash64(column.cast("bigint"))


def key_filter(keys: DataFrame, name: str):
    """Function from an array of ``key_hash`` to flags, true for all of ``keys[name]`` and for few others.

    A Bloom filter in front of a join: rows that cannot match need no shuffle,
    the join itself stays exact.  Its size is bounded; with more than some ten
    million keys it lets more and more rows pass.  ``keys`` is read twice.
    """
    bits = min(FILTER_BITS, 1 << max(16, (KEY_BITS * keys.count() - 1).bit_length()))

    def run(batches):
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(held, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        word = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int64()), "bits": pa.array(held[word].view(np.int64), pa.int64())})

    hashed = keys.select(key_hash(F.col(name)).alias("h"))
    words = map_batches(hashed, run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(bits // 64, np.uint64)
    full[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(full)

    def test(hashed: np.ndarray) -> np.ndarray:
        at = _places(hashed, bits)
        return (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=0)

    return test


def in_filter(test, column) -> "F.Column":
    """Condition that ``test`` (of ``key_filter``) holds.  Its Python worker is one more in its stage: use it where the stage has no other."""

    @F.pandas_udf("boolean")
    def holds(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy()))

    return holds(key_hash(column))


def words_column(text) -> "F.Column":
    """Array of words of a text column; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def slices(items: list, weight, budget: int):
    """Consecutive slices of ``items`` of at most ``budget`` total weight (one item at least)."""
    lo, total = 0, 0
    for i, x in enumerate(items):
        w = weight(x)
        if i > lo and total + w > budget:
            yield lo, i
            lo, total = i, 0
        total += w
    if lo < len(items):
        yield lo, len(items)
