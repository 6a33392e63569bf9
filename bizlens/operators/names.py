"""Business-name pipeline: stage 1 (N1), hold resolution (N2), final prep.

Everything is one lazy plan: no driver round trip, no Python worker.

The dictionary match (J5) - "first dictionary entry, longest first, contained
in the text" - is an exact equi-join: each held name is exploded into its
character positions, joined to the dictionary on the first character of the
entry, and verified with ``substr``.  Work is linear in text length times the
entries sharing a first character; the dictionary is bounded by ``top_n``, so
broadcasting it is safe.  The best entry per row is a ``min`` of the match
order whose partial aggregation collapses each row's candidates before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import frequent
from .filters import is_hold

NAME_COLS = ["unique_id", "bizname", "clean_name", "clean_result"]


def clean_names(df: DataFrame, id_col: str = "unique_id", name_col: str = "bizname") -> DataFrame:
    """Clean every name; rows whose rule yields null try Latin recovery.

    The reference overlays recovered values by key (J4); since both values
    come from the same row, the overlay is a row-local ``coalesce``.
    Recovered text equal to ``null`` is discarded.
    """
    base = df.select(F.col(id_col).alias("unique_id"), F.col(name_col).alias("bizname"))
    staged = tx.with_clean_business_name(base, "bizname", "_c1")
    staged = staged.withColumn("_c2", tx.recover_parenthesised_latin("bizname"))
    clean = staged.select("unique_id", "bizname", F.coalesce(
        F.col("_c1"), F.when(F.col("_c2") != "null", F.col("_c2"))).alias("_clean"))
    return clean.select("unique_id", "bizname", F.col("_clean").alias("clean_name"),
                        F.col("_clean").alias("clean_result"))


def brand_dictionary(df: DataFrame, col: str = "clean_result", top_n: int = 500, sketched: bool = False) -> DataFrame:
    """A1 + T1/T2: the ``top_n`` most frequent names of length >= 2.

    ``sketched`` finds them through frequent-items sketches (see ``frequent``),
    for registers of so many different names that counting all of them costs
    more than a second scan; the result is the same.

    Ties in frequency are broken by name (the reference leaves them
    unspecified).  ``match_order`` is the matching order: length desc, then
    count desc, then name.  The result has at most ``top_n`` rows, so the
    un-partitioned window below runs on a bounded input.
    """
    long = df.where(F.length(F.col(col)) >= 2)
    if sketched:
        top = frequent.most_frequent(long, col, top_n).withColumnRenamed("value", "brand")
    else:
        counts = long.groupBy(F.col(col).alias("brand")).agg(F.count(F.lit(1)).alias("cnt"))
        top = counts.orderBy(F.desc("cnt"), F.asc("brand")).limit(top_n)
    order = Window.orderBy(F.length("brand").desc(), F.desc("cnt"), F.asc("brand"))
    # Bounded by top_n rows and read by several branches of the match:
    # cached so it is computed once.
    return top.select("brand", "cnt", F.row_number().over(order).alias("match_order")).persist(
        StorageLevel.MEMORY_AND_DISK)


#: Dictionary entries up to which every row tries them in place.
LOCAL_ENTRIES = 5000


def _is_word(ch: Column) -> Column:
    return F.coalesce(tx.is_word_char(ch), F.lit(False))


def first_entry(df: DataFrame, text: str, dictionary: DataFrame, entry_col: str = "brand", order_col: str = "match_order") -> DataFrame:
    """J5 in place: ``df`` with ``entry_col``, the first dictionary entry contained in the column ``text``, or null.

    The dictionary is one sorted array from an uncorrelated scalar subquery, and
    the rows try it with higher-order functions: no shuffle, no join, and no row
    is taken apart.  For dictionaries of at most ``LOCAL_ENTRIES`` entries.
    """
    entries = dictionary.where(F.length(entry_col) > 0).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order_col).alias("o"), F.col(entry_col).alias("e"), ((F.length(entry_col) <= 2) & F.col(entry_col).rlike("[a-z]")).alias("short")))).alias("es")).scalar()
    t = F.col(text)

    def bounded(e: Column) -> Column:
        """Some occurrence of ``e`` whose two ends are word borders."""
        n = F.length(e)

        def at(p: Column) -> Column:
            before = F.when(p > 1, F.substring(t, p - 1, F.lit(1)))
            after = F.when(p + n <= F.length(t), F.substring(t, p + n, F.lit(1)))
            return ((F.substring(t, p, n) == e) & (_is_word(before) != _is_word(F.substring(e, F.lit(1), F.lit(1))))
                    & (_is_word(F.substring(e, n, F.lit(1))) != _is_word(after)))

        return F.exists(F.sequence(F.lit(1), F.length(t)), at)

    def holds(x: Column) -> Column:
        return F.contains(t, x["e"]) & (~x["short"] | bounded(x["e"]))

    # a subquery may not stand inside a higher-order function, so it is a column first
    found = F.when(F.length(t) > 0, F.get(F.filter("_entries", holds), F.lit(0))["e"])
    return df.withColumn("_entries", entries).withColumn(entry_col, found).drop("_entries")


def match_dictionary(df: DataFrame, text_col: str, dictionary: DataFrame,
                     keep: Sequence[str] = ("unique_id",), entry_col: str = "brand",
                     order_col: str = "match_order") -> DataFrame:
    """Per row, the first entry (lowest ``order_col``) contained in the text.

    Entries of at most two characters that contain ``a-z`` must sit on word
    boundaries (Python ``\\b`` semantics); longer ones are plain substrings.
    Only rows with a match are returned (``keep`` columns + ``entry_col``);
    ``keep`` must identify a row.  Dictionaries beyond ``LOCAL_ENTRIES`` go
    through ``match_by_position``, with the same result.
    """
    if dictionary.limit(LOCAL_ENTRIES + 1).count() <= LOCAL_ENTRIES:
        return first_entry(df.select(*keep, F.col(text_col).alias("_t")), "_t", dictionary, entry_col, order_col).drop("_t").where(F.col(entry_col).isNotNull())
    return match_by_position(df, text_col, dictionary, keep, entry_col, order_col)


def match_by_position(df: DataFrame, text_col: str, dictionary: DataFrame, keep: Sequence[str] = ("unique_id",),
                      entry_col: str = "brand", order_col: str = "match_order") -> DataFrame:
    """J5 for large dictionaries: an index of the entries by their first characters meets the characters of the texts.

    Work is linear in the texts; nothing is broadcast by force.
    """
    d = dictionary.select(
        F.col(entry_col).alias("_e"), F.col(order_col).alias("_o"),
        F.length(entry_col).alias("_el"), F.substring(entry_col, 1, 1).alias("_k"),
        ((F.length(entry_col) <= 2) & F.col(entry_col).rlike("[a-z]")).alias("_short"))
    t = F.col("_t")
    pos = (df.select(*keep, F.col(text_col).alias("_t"))
           .where(F.length(t) > 0)
           .select("*", F.explode(F.sequence(F.lit(1), F.length(t))).alias("_p"))
           .select("*", F.substring(t, F.col("_p"), 1).alias("_k")))
    cand = pos.join(d, on="_k", how="inner")
    cand = cand.where(F.expr("substring(_t, _p, _el)") == F.col("_e"))

    prev_ch = F.when(F.col("_p") > 1, F.expr("substring(_t, _p - 1, 1)"))
    next_ch = F.when(F.col("_p") + F.col("_el") <= F.length(t), F.expr("substring(_t, _p + _el, 1)"))
    first_ch = F.substring("_e", 1, 1)
    last_ch = F.expr("substring(_e, _el, 1)")
    bounded = (_is_word(prev_ch) != _is_word(first_ch)) & (_is_word(last_ch) != _is_word(next_ch))
    cand = cand.where(~F.col("_short") | bounded)
    # min over the integer order keeps the aggregation hash-based (a string
    # min_by would force a sort aggregate); the entry is looked up afterwards.
    best = cand.groupBy(*keep).agg(F.min("_o").alias("_o"))
    return best.join(d.select("_o", F.col("_e").alias(entry_col)), on="_o").select(*keep, entry_col)


def keep_frequent(df: DataFrame, col: str, min_count: int, sketched: bool = False) -> DataFrame:
    """A2: keep rows whose ``col`` value occurs at least ``min_count`` times.

    ``sketched`` finds the values through frequent-items sketches, with the same result.
    """
    if sketched:
        often = frequent.at_least(df, col, min_count).select(F.col("value").alias(col))
    else:
        often = df.groupBy(col).count().where(F.col("count") >= min_count).select(col)
    return df.join(often, on=col, how="left_semi")


def hold_branches(stage1: DataFrame, top_n: int = 500, persist: bool = True
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rest, held rows with their corp-stripped text, brand dictionary).

    ``stage1`` feeds all three, so it is persisted once (memory, spilling to
    disk; lost blocks recompute from lineage).  The cache is also a barrier:
    without it the optimizer pushes the hold filter below the cleaning
    projection and evaluates the whole regex chain again inside the filter
    and the aggregation key.
    """
    if persist:
        stage1 = stage1.persist(StorageLevel.MEMORY_AND_DISK)
    hold = is_hold("clean_result")
    rest = stage1.where(~hold)
    held = stage1.where(hold).select("unique_id", "bizname", tx.strip_corp_tokens("bizname").alias("hold_text"))
    return rest, held, brand_dictionary(rest, "clean_result", top_n)


def resolve_held_names(stage1: DataFrame, top_n: int = 500, min_freq: int = 500,
                       stopwords: Sequence[str] = tx.STOPWORDS, persist: bool = True) -> DataFrame:
    """Resolve held names through the brand dictionary.

    Held rows keep the first frequent, non-stop-word dictionary brand found in
    their corp-stripped raw name and are dropped otherwise; all other rows
    (nulls included) pass unchanged.  See ``hold_branches`` for the cache.
    """
    rest, held, dictionary = hold_branches(stage1, top_n, persist)
    matched = match_dictionary(held, "hold_text", dictionary, keep=("unique_id", "bizname"))
    if persist:
        # read twice; and as a barrier: a later filter on the brand would be pushed
        # below the match and run it once more for each of its conditions
        matched = matched.persist(StorageLevel.MEMORY_AND_DISK)
    # Brands are dictionary entries, so this table has at most top_n rows.
    good = (matched.groupBy("brand").count()
            .where((F.col("count") >= min_freq) & ~F.col("brand").isin(list(stopwords)))
            .select("brand"))
    resolved = (matched.join(F.broadcast(good), on="brand", how="left_semi")
                .select("unique_id", "bizname", F.col("brand").alias("clean_name"),
                        F.col("brand").alias("clean_result")))
    return rest.select(*NAME_COLS).unionByName(resolved)


def prepare_names(df: DataFrame) -> DataFrame:
    """Brand map, lower, drop null, F5, special tokens (C4), min length 2."""
    cn = F.lower(tx.standardise_brand("clean_name"))
    cr = F.lower(tx.standardise_brand("clean_result"))
    out = df.select("unique_id", "bizname", cn.alias("clean_name"), cr.alias("clean_result"))
    out = out.where(tx.is_not_numeric_except_year("clean_name"))
    out = out.select("unique_id", "bizname", tx.clean_special_tokens("clean_name").alias("clean_name"),
                     tx.clean_special_tokens("clean_result").alias("clean_result"))
    # C4 leaves no white space at the ends, so the length is that of the stripped name
    return out.where(F.length("clean_name") > 1)


def final_name_table(licences: DataFrame, top_n: int = 500, min_freq: int = 500,
                  stopwords: Sequence[str] = tx.STOPWORDS) -> DataFrame:
    """N1 -> N2 -> N3: the final cleaned-name table (unique_id, bizname, clean_name, clean_result).

    Persisted (memory, spilling to disk): the table feeds several features,
    and the franchise flag alone reads it twice (counts and join-back).
    """
    names = prepare_names(resolve_held_names(clean_names(licences), top_n, min_freq, stopwords))
    return names.persist(StorageLevel.MEMORY_AND_DISK)
