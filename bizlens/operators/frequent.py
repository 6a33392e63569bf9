"""Heavy hitters (A1, A2, T2): a sketch names the candidates, an exact count settles them.

Counting every distinct value shuffles them all, although a top list or a high
threshold needs a few.  Here the values are dealt by hash to ``PARTS`` groups,
and each group keeps a mergeable frequent-items sketch that combines before the
shuffle, so a task sends at most ``PARTS`` sketches whatever it has read.  A
second scan counts the candidates exactly.

The proof: a sketch that tracks m values of a group of N rows errs by at most
``ERROR * N / m`` a value, so a value that it does not report stands on at most
twice that many rows, or on no more than its least reported estimate if it
reported as many as it was asked for.  The exact counts are final when the
wanted ones lie above that bound, or when the candidates cover every row.  Where
neither holds (many values of nearly equal frequency), all values are counted
the plain way, so the result is exact in every case.

Nulls are not counted.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Groups of values, each with a sketch of its own; below the number of groups at which Spark sorts sketches.
PARTS = 16
#: Values that a sketch tracks.
TRACKED = 8192
#: Characters of all candidates up to which they are sent to the tasks; longer ones are joined by a shuffle.
SENT_CHARS = 8_000_000
#: A sketch of a map of M places errs by at most 3.5 / M of its rows, and Spark makes M at least tracked / 0.75.
ERROR = 3.5 * 0.75


def _counted(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def candidates(df: DataFrame, col: str, report: int, tracked: int = TRACKED) -> tuple[DataFrame, int, int]:
    """((value, cnt) of the candidates with exact counts, bound of the count of any other value, rows of non-null values).

    At most ``PARTS * report`` rows, written once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tracked = max(tracked, report)
    rows = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull())
    sketched = rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(PARTS)).alias("part")).agg(
        F.expr(f"approx_top_k(value, {int(report)}, {int(tracked)})").alias("top"), F.count(F.lit(1)).alias("n")).checkpoint()
    missed = F.floor(2 * ERROR * F.col("n") / tracked)
    full = F.when(F.size("top") >= report, F.array_min(F.transform("top", lambda t: t["count"]))).otherwise(F.lit(0))
    chars = F.aggregate("top", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["item"].cast("string")))
    total = sketched.agg(F.max(F.greatest(missed, full)).alias("bound"), F.sum("n").alias("n"), F.sum(chars).alias("chars")).first()
    named = sketched.select(F.explode("top").alias("t")).select(F.col("t.item").alias("value"))
    if (total["chars"] or 0) <= SENT_CHARS:
        named = F.broadcast(named)
    exact = _counted(rows.join(named, "value", "left_semi"), "value").checkpoint()
    return exact, int(total["bound"] or 0), int(total["n"] or 0)


def most_frequent(df: DataFrame, col: str, n: int, tracked: int = TRACKED) -> DataFrame:
    """(value, cnt) of the ``n`` most frequent values, equal counts by ascending value."""
    exact, bound, rows = candidates(df, col, 2 * n, tracked)
    top = exact.orderBy(F.desc("cnt"), F.asc("value")).limit(n)
    seen = exact.agg(F.sum("cnt").alias("rows")).first()["rows"] or 0
    last = top.agg(F.count(F.lit(1)).alias("k"), F.min("cnt").alias("least")).first()
    if seen == rows or (last["k"] == n and last["least"] > bound):
        return top
    return _counted(df.where(F.col(col).isNotNull()), col).orderBy(F.desc("cnt"), F.asc("value")).limit(n)


def at_least(df: DataFrame, col: str, min_count: int, report: int = 1024, tracked: int = TRACKED) -> DataFrame:
    """A2: (value, cnt) of the values that occur at least ``min_count`` times."""
    exact, bound, rows = candidates(df, col, report, tracked)
    frequent = exact.where(F.col("cnt") >= min_count)
    if bound < min_count or (exact.agg(F.sum("cnt").alias("rows")).first()["rows"] or 0) == rows:
        return frequent
    return _counted(df.where(F.col(col).isNotNull()), col).where(F.col("cnt") >= min_count)
