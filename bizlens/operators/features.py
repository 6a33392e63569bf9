"""Feature derivation.

Hot names (franchises) are the skew risk here: a single brand can hold a large
share of all rows.  Name frequencies are therefore computed with a map-side
partial aggregation and joined back (AQE broadcasts the frequent-name table
when it is small at runtime and splits skewed partitions when it is not);
a ``count() over (partition by name)`` window would put a hot name's rows
into one task and is never used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operating-period buckets in years (the reference names the feature but not
# its edges; this default is our choice and a parameter).
DEFAULT_PERIOD_EDGES = (1, 3, 5, 10)


def franchise_flag(names: DataFrame, min_count: int = 20, name_col: str = "clean_name",
                   id_col: str = "unique_id") -> DataFrame:
    """A3: ``is_franchise`` = 1 when the cleaned name occurs >= ``min_count`` times.

    Returns ``(id_col, is_franchise)`` for every row of ``names``; null names get 0.
    """
    frequent = (names.groupBy(name_col).agg(F.count(F.lit(1)).alias("_n"))
                .where((F.col("_n") >= min_count) & F.col(name_col).isNotNull())
                .select(name_col, F.lit(1).alias("_f")))
    joined = names.select(id_col, name_col).join(frequent, on=name_col, how="left")
    return joined.select(id_col, F.coalesce(F.col("_f"), F.lit(0)).alias("is_franchise"))


def stratum_key(*cols: str) -> Column:
    """``concat_ws('_', ...)`` of the string forms (nulls are skipped)."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def operating_days(start_col: str, end_col: str, as_of: str) -> Column:
    """Days from licence to closure, or to ``as_of`` for open businesses."""
    return F.datediff(F.coalesce(F.col(end_col), F.to_date(F.lit(as_of))), F.col(start_col))


def period_bucket(days: Column, edges_years: Sequence[int] = DEFAULT_PERIOD_EDGES) -> Column:
    """C14: bucket label of an operating period given in days.

    Edges are whole years of 365 days; labels read ``<1y``, ``1-3y`` ... ``10y+``.
    """
    edges = list(edges_years)
    expr = None
    lo = None
    for e in edges:
        label = f"<{e}y" if lo is None else f"{lo}-{e}y"
        cond = days < F.lit(e * 365)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        lo = e
    return expr.when(days.isNotNull(), F.lit(f"{lo}y+"))


def flatten_array(df: DataFrame, array_col: str, prefix: str, size: int,
                  keep: Sequence[str] = (), cast: str = "double") -> DataFrame:
    """One column per array element (``prefix0 .. prefix{size-1}``).

    The array column itself is not kept: its name would match the prefix.
    ``get`` returns null past the end instead of failing under ANSI mode; an
    array longer than ``size`` raises instead of losing its tail.
    """
    arr = F.when(F.size(array_col) > size, F.raise_error(F.lit(f"{array_col} has more than {size} elements"))).otherwise(F.col(array_col))
    return df.select(*keep, *[F.get(arr, i).cast(cast).alias(f"{prefix}{i}") for i in range(size)])
