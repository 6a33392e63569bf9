"""Published summaries: closure table with subtotals (A13), survival (A14),
quarterly trend (A15), and the rare-category filter (F4).

All are grouped aggregations with map-side partial aggregation; windows are
partitioned by the grouping dimensions and run on the aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closure_summary(df: DataFrame, dims: Sequence[str], closed_col: str = "closed",
                    rollup: bool = True) -> DataFrame:
    """Stores, closures and closure rate per group, with subtotals.

    ``rollup`` adds one subtotal level per dimension prefix plus the grand
    total; ``grouping_id`` tells the levels apart (bit set = rolled up).
    """
    aggs = [F.count(F.lit(1)).alias("n_stores"),
            F.sum(F.col(closed_col)).cast("bigint").alias("n_closed")]
    g = df.rollup(*dims) if rollup else df.groupBy(*dims)
    if rollup:
        aggs.append(F.grouping_id(*dims).cast("int").alias("level"))
    out = g.agg(*aggs)
    return out.withColumn("closure_rate", F.round(F.col("n_closed") / F.col("n_stores"), 6))


def survival_summary(df: DataFrame, dims: Sequence[str], start_col: str, end_col: str,
                     as_of: str, years: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Operating-duration stats and n-year survival per group.

    Only businesses licensed at least n years before ``as_of`` enter the
    n-year denominator; a business survives n years when it was not closed
    by ``start + n*365`` days.
    """
    start, end = F.col(start_col), F.col(end_col)
    asof = F.to_date(F.lit(as_of))
    dur = F.datediff(F.coalesce(end, asof), start)
    aggs = [F.count(F.lit(1)).alias("n_stores"),
            F.round(F.avg(dur), 6).alias("avg_days"),
            F.round(F.avg(F.when(end.isNotNull(), F.datediff(end, start))), 6).alias("avg_days_closed")]
    for n in years:
        horizon = F.date_add(start, n * 365)
        observable = horizon <= asof
        survived = observable & (end.isNull() | (end > horizon))
        n_obs = F.sum(F.when(observable, 1).otherwise(0))
        n_surv = F.sum(F.when(survived, 1).otherwise(0))
        aggs += [n_obs.cast("bigint").alias(f"n_obs_{n}y"),
                 F.round(n_surv / F.nullif(n_obs, F.lit(0)), 6).alias(f"survival_{n}y")]
    return df.groupBy(*dims).agg(*aggs)


def quarterly_trend(df: DataFrame, dims: Sequence[str], date_col: str,
                    value_col: str | None = None) -> DataFrame:
    """Per group and quarter, the value (count or sum) and its change vs
    the quarter before (null when the group has no rows in that quarter)."""
    q = F.trunc(F.col(date_col), "quarter").alias("quarter")
    val = F.count(F.lit(1)) if value_col is None else F.sum(F.col(value_col))
    agg = df.groupBy(*dims, q).agg(val.cast("bigint").alias("value"))
    w = Window.partitionBy(*dims).orderBy("quarter")
    prev = F.when(F.add_months(F.lag("quarter").over(w), 3) == F.col("quarter"), F.lag("value").over(w))
    return agg.select(*dims, "quarter", "value", prev.alias("prev_value"),
                      (F.col("value") - prev).alias("change"),
                      F.round((F.col("value") - prev) / prev, 6).alias("change_rate"))


def drop_rare(df: DataFrame, cat: str, closed_col: str = "closed", min_excl: int = 100) -> DataFrame:
    """drop categories with at most ``min_excl`` closures."""
    keep = (df.groupBy(cat).agg(F.sum(F.col(closed_col)).alias("_c"))
            .where(F.col("_c") > min_excl).select(cat))
    return df.join(keep, on=cat, how="left_semi")
