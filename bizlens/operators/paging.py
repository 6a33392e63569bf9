"""Paging and set operations.

S9 replaces the reference's page loop (sort + limit + subtract per page,
O(n^2 / page)) with one pass: a global 0-based row index in key order, then
integer division.  The global index is a range partitioning of the keys, a
sort inside each range, and one prefix sum over the row counts of the ranges:
no one-task ``row_number() over (order by key)``, and nothing is cast, so texts,
decimals, integers of any size and composite keys keep their own order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_index(df: DataFrame, key: str | Sequence[str], out: str = "idx", buckets: int | None = None) -> DataFrame:
    """Rows of ``df`` with a 0-based bigint index in the order of ``key`` (one column or several).

    Nulls come first; rows of equal keys are numbered in some order, without
    gaps.  The number of ranges is ``buckets`` or else the session's shuffle
    partitions, so it follows the cluster; a key that many rows share is split
    over ranges by the row's number in the input.  The ranges are checkpointed in the shared folder,
    so the numbers stay the same when an executor is lost.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ensure_checkpoint_dir(df.sparkSession)
    # the input is one column, so no name of it can clash
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("tie"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    order = [f"k{i}" for i in range(len(keys))] + ["tie"]
    dealt = rows.repartitionByRange(buckets, *order) if buckets else rows.repartitionByRange(*order)
    ranges = dealt.sortWithinPartitions(*order).select("row").checkpoint()
    place = F.monotonically_increasing_id()  # partition number, then the row's place in it
    placed = ranges.select("row", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a row a range: the window and the broadcast are bounded by the number of shuffle partitions
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return placed.join(F.broadcast(first), "part").select(
        *[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], (F.col("first") + F.col("place")).alias(out))


def assign_batches(df: DataFrame, key: str | Sequence[str], batch: int = 10_000, sub: int = 5_000) -> DataFrame:
    """Add ``idx``, ``batch_no`` = idx div batch, ``sub_no`` = (idx mod batch) div sub."""
    idx = global_index(df, key, "idx")
    return idx.withColumn("batch_no", F.expr(f"idx div {int(batch)}")).withColumn("sub_no", F.expr(f"(idx % {int(batch)}) div {int(sub)}"))


def top_n(df: DataFrame, n: int, by: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in ``by`` order (per-partition top-n, then merge)."""
    return df.orderBy(*by).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b`` (EXCEPT DISTINCT)."""
    return a.subtract(b)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: distinct value combinations."""
    return df.select(*cols).distinct()


def row_count(df: DataFrame, alias: str = "n_rows") -> DataFrame:
    """A5: row count as a one-row DataFrame (no driver round trip)."""
    return df.agg(F.count(F.lit(1)).alias(alias))
