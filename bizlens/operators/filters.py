"""Row filters.

All are plain predicates so Catalyst can push them into the scan where the
column is stored (not derived).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def in_window(df: DataFrame, closure_col: str, since_year: int) -> DataFrame:
    """keep still-open rows (null closure) and closures on/after ``since_year``.

    Written as a date range, not ``year(col) >= y``: a range on a stored
    column reaches the parquet reader as a pushed filter; a function of the
    column does not.
    """
    c = F.col(closure_col)
    return df.where((c >= F.make_date(F.lit(since_year), F.lit(1), F.lit(1))) | c.isNull())


def needs_address_lookup(df: DataFrame, x: str, y: str, addr: str) -> DataFrame:
    """a coordinate is missing and the address is non-blank.

    Blank means empty after removing U+0020 only (SQL ``TRIM``), as the
    reference query does: a tab-only address still passes.
    """
    return df.where((F.col(x).isNull() | F.col(y).isNull())
                    & F.col(addr).isNotNull() & (F.trim(F.col(addr)) != ""))


def is_hold(col: str | Column, sentinel: str = tx.HOLD) -> Column:
    """F3 predicate: null-safe equality with the sentinel (never null itself)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.eqNullSafe(F.lit(sentinel))


def split_hold(df: DataFrame, col: str, sentinel: str = tx.HOLD) -> tuple[DataFrame, DataFrame]:
    """(held rows, the rest).  The rest keeps nulls, as pandas ``!=`` does."""
    h = is_hold(col, sentinel)
    return df.where(h), df.where(~h)


def keep_not_numeric(df: DataFrame, col: str) -> DataFrame:
    """drop digit-only names unless they are four digits long (a year)."""
    return df.where(tx.is_not_numeric_except_year(col))


def min_len(df: DataFrame, col: str, n: int = 2) -> DataFrame:
    """keep rows whose stripped value has at least ``n`` characters."""
    return df.where(F.length(tx.py_strip(col)) >= n)


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def drop_stopwords(df: DataFrame, col: str, words: Sequence[str] = tx.STOPWORDS) -> DataFrame:
    """F8: drop rows whose value is a stop-word (null values are dropped too)."""
    return df.where(~F.col(col).isin(list(words)))


def keep_in(df: DataFrame, col: str, lookup: DataFrame, lookup_col: str | None = None) -> DataFrame:
    """membership against a derived value list, as a semi join.

    The value list stays a DataFrame (never collected into an ``isin``); the
    planner broadcasts it when its runtime size is small (AQE).
    """
    lk = lookup.select(F.col(lookup_col or col).alias(col)).distinct()
    return df.join(lk, on=col, how="left_semi")
