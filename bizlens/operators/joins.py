"""Key joins.

Join strategy is left to the planner: with AQE on, a side whose *runtime*
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` is broadcast,
otherwise the join sort-merges on the key and AQE splits skewed partitions.
An explicit ``broadcast`` appears only where the side has a structural size
bound (documented at the call site).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_default(df: DataFrame, dim: DataFrame, on: str | Sequence[str],
                      defaults: Mapping[str, object]) -> DataFrame:
    """Left join ``dim`` and fill its columns' nulls with defaults.

    Columns of ``df`` that ``dim`` brings in are dropped first, as the
    reference drops a stale ``is_franchise`` before re-joining it.
    """
    keys = [on] if isinstance(on, str) else list(on)
    incoming = [c for c in dim.columns if c not in keys]
    base = df.drop(*[c for c in incoming if c in df.columns])
    out = base.join(dim, on=keys, how="left")
    return out.fillna(dict(defaults)) if defaults else out


def left_join_prefix(df: DataFrame, dim: DataFrame, on: str, prefix: str,
                     default: float = 0.0) -> DataFrame:
    """Left join every ``prefix*`` column of ``dim``, each coalesced to ``default``.

    One projection of ``coalesce`` expressions (not a ``withColumn`` per column).
    """
    cols = [c for c in dim.columns if c.startswith(prefix) and c != on]
    right = dim.select(on, *cols)
    joined = df.join(right, on=on, how="left")
    keep = [F.col(c) for c in df.columns]
    filled = [F.coalesce(F.col(c), F.lit(default).cast(right.schema[c].dataType)).alias(c) for c in cols]
    return joined.select(*keep, *filled)


def complement(df: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``subset`` (left anti join)."""
    return df.join(subset.select(key), on=key, how="left_anti")


def overlay(a: DataFrame, b: DataFrame, key: str, cols: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Non-null values of ``b`` overwrite ``a`` at the same (unique) key.

    ``cols`` maps a column of ``a`` to the column of ``b`` that overrides it
    (a list means the same names on both sides).  A key of ``a`` that stands
    twice in ``b`` raises an error when the row is computed: two values cannot
    both win, and the rows of ``a`` never multiply.  The check groups ``b`` by
    the key of the join, so it needs no shuffle of its own.  Null keys match nothing.
    """
    mapping = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    values = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(mapping.values())])
    right = b.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_ok")).agg(F.first(values).alias("_ov"), F.count(F.lit(1)).alias("_on"))
    joined = a.join(right, a[key] == right["_ok"], "left")
    place = {c: i for i, c in enumerate(mapping)}
    twice = F.raise_error(F.concat(F.lit("overlay: repeated key "), F.col("_ok").cast("string")))

    def over(c: str):
        return F.coalesce(F.when(F.col("_on") > 1, twice.cast(b.schema[mapping[c]].dataType)).otherwise(F.col(f"_ov.v{place[c]}")), a[c]).alias(c)

    return joined.select(*[over(c) if c in mapping else a[c] for c in a.columns])


def attach_embedding(df: DataFrame, vectors: DataFrame, name_col: str, word_col: str = "word",
                     vector_col: str = "vector", dim: int = 50, out_col: str = "embedding_array") -> DataFrame:
    """Name -> vector lookup; names without a vector get ``dim`` zeros."""
    v = vectors.select(F.col(word_col).alias("_w"), F.col(vector_col).alias("_v"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = df.join(v, df[name_col] == v["_w"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(F.col("_v"), zeros).alias(out_col))


def merge_region(licences: DataFrame, spatial: DataFrame, lookup: DataFrame, key: str,
                 cols: Sequence[str] = ("sido", "sigungu", "dong")) -> DataFrame:
    """One row per licence (and lookup hit): region from coordinates where
    present, else from the address lookup, else null.

    All inputs are keyed by licence id (``key``); the lookup's stored address
    is the cleaned one, so the join must use the id, never the address text.
    """
    s = spatial.select(key, *[F.col(c).alias(f"_s_{c}") for c in cols])
    lk = lookup.select(key, *[F.col(c).alias(f"_l_{c}") for c in cols])
    j = licences.select(key).join(s, on=key, how="left").join(lk, on=key, how="left")
    has_spatial = F.col(f"_s_{cols[0]}").isNotNull()
    out = [F.when(has_spatial, F.col(f"_s_{c}")).otherwise(F.col(f"_l_{c}")).alias(c) for c in cols]
    src = F.when(has_spatial, F.lit("spatial")).when(F.col(f"_l_{cols[0]}").isNotNull(), F.lit("lookup"))
    return j.select(key, *out, src.alias("region_source"))
