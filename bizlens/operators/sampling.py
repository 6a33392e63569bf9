"""Exact, seeded, partition-independent sampling.

Core primitive (``select_smallest``): within each stratum, select the k rows
with the smallest seeded hash (ties by key), where k is a function of the
stratum size.  A per-stratum ``row_number`` window would put a whole stratum
- possibly a third of all rows - into one task, so instead:

1. one scan counts every stratum and keeps a KLL sketch of its hashes (one row
   per stratum leaves the scan); the sketch brackets the hash of row k;
2. a second scan counts the rows below the bracket and lists those inside it
   (about one in a hundred), dealt by hash, not by stratum, and written once;
3. a prefix sum over ``SUB`` sub-ranges of each bracket names the one that holds
   row k; only its rows are ranked.  A sketch errs with some probability: where
   the counts prove that its bracket missed row k, the stratum is listed again
   with the whole range of hashes, so the threshold is always exact;
4. one map-side filter compares each row with the threshold of its stratum: the
   base is never shuffled while the thresholds, one row per stratum, are few
   enough to send to the tasks (``BROADCAST_STRATA``); more are joined by key.

Steps 1-3 run when the operator is called.  Results depend only on keys and the
seed, never on partitioning or the sketch, so a test set and its complement (J3)
agree on recompute.  Rows that share a key share their fate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, seeded_hash
from ..session import ensure_checkpoint_dir

Quota = Callable[[Column, Column, Column], Column]   # (stratum size, total size, smallest stratum) -> k


#: Strata whose thresholds are sent to the tasks (some 50 bytes each); beyond it they are joined by a shuffle.
BROADCAST_STRATA = 100_000
#: Size of the sketches (at most some 100 kB a stratum) and how far around row k their bracket reaches, in ranks of the
#: stratum: three times the error that a sketch of this size exceeds once in a hundred times.
SKETCH_K, SKETCH_REACH = 4096, 0.004
#: Steps of the ranks that a sketch is asked for.
GRID = 1000
#: Sub-ranges of a bracket; a power of two.
SUB = 4096


def _fixed(df: DataFrame, few: bool) -> tuple[DataFrame, int]:
    """``df`` as rows that no recomputation can change, and their number: sent along with the plan if ``few``, else written once."""
    if few:
        rows = df.collect()
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), len(rows)
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out, out.count()


def _listed(base: DataFrame, wanted: DataFrame, match: Column, key: str) -> DataFrame:
    """Per stratum in ``wanted``: one row of ``_sub`` -1 that counts what lies below the bracket, and the rows inside, written once."""
    inside = F.col("_h") >= F.col("_lo")
    sub = F.least(((F.col("_h") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * SUB).cast("int"), F.lit(SUB - 1))
    near = base.join(wanted, on=match).where(F.col("_h") <= F.col("_hi")).select(
        "_id", "_k", F.when(inside, sub).otherwise(-1).alias("_sub"), F.when(inside, F.col("_h")).alias("_h"), F.when(inside, F.col(key)).alias("_key"))
    ensure_checkpoint_dir(base.sparkSession)
    return near.groupBy("_id", "_k", "_sub", "_h", "_key").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)


def _kth(listed: DataFrame, few: bool) -> DataFrame:
    """(_id, _th, _tk) of every stratum whose row k is inside its bracket."""
    by = Window.partitionBy("_id").orderBy("_sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = listed.groupBy("_id", "_k", "_sub").agg(F.sum("_c").alias("_n")).withColumn("_cum", F.sum("_n").over(by))
    before = F.col("_cum") - F.col("_n")
    cut = hist.where((F.col("_sub") >= 0) & (before < F.col("_k")) & (F.col("_cum") >= F.col("_k"))).select("_id", "_sub", (F.col("_k") - before).alias("_need"))
    # one row per stratum
    rows = listed.join(F.broadcast(cut) if few else cut, ["_id", "_sub"])
    upto = F.sum("_c").over(Window.partitionBy("_id").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_r", upto).where((F.col("_r") >= F.col("_need")) & (F.col("_r") - F.col("_c") < F.col("_need")))
    return rows.select("_id", F.col("_h").alias("_th"), F.col("_key").alias("_tk"))


def _thresholds(base: DataFrame, strata: list[str], quota: Quota, key: str) -> tuple[DataFrame, Column]:
    """Per stratum that selects any row: (_k<i>..., _th, _tk) - rows up to (hash, key) are selected - and the join condition."""
    names = [f"_k{i}" for i in range(len(strata))]
    match = F.lit(True)
    for c, k in zip(strata, names):
        match = match & F.col(c).eqNullSafe(F.col(k))
    stats = base.groupBy(*[F.col(c).alias(k) for c, k in zip(strata, names)]).agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_bigint("_h", F.lit(SKETCH_K)).alias("_s")).where("_n > 0")
    ensure_checkpoint_dir(base.sparkSession)
    stats = stats.checkpoint(eager=True)
    sizes = stats.agg(F.sum("_n").alias("tot"), F.min("_n").alias("least"), F.count(F.lit(1)).alias("strata")).first()
    few = sizes["strata"] <= BROADCAST_STRATA
    k = F.least(F.greatest(quota(F.col("_n"), F.lit(sizes["tot"] or 0), F.lit(sizes["least"] or 0)).cast("bigint"), F.lit(0)), F.col("_n"))
    # the sketch answers constant ranks only: a grid of them, from which the bracket takes the nearest outside
    grid = F.kll_sketch_get_quantile_bigint("_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    q = F.col("_k") / F.col("_n")
    low, high = F.floor((q - SKETCH_REACH) * GRID).cast("int"), F.ceil((q + SKETCH_REACH) * GRID).cast("int")
    brackets = stats.withColumn("_k", k).where("_k > 0").select(
        *names, "_k", F.monotonically_increasing_id().alias("_id"),
        F.when(low > 0, F.get(grid, low)).otherwise(F.lit(0)).alias("_lo"),
        F.when(high < GRID, F.get(grid, high)).otherwise(F.lit((1 << HASH_BITS) - 1)).alias("_hi"))
    brackets, wanted = _fixed(brackets, few)
    got, found = _fixed(_kth(_listed(base, brackets, match, key), few), few)
    if found < wanted:
        whole = brackets.join(got, "_id", "left_anti").withColumns({"_lo": F.lit(0).cast("bigint"), "_hi": F.lit((1 << HASH_BITS) - 1).cast("bigint")})
        got, _ = _fixed(got.unionByName(_kth(_listed(base, F.broadcast(whole) if few else whole, match, key), few)), few)
    limits = brackets.join(got, "_id").select(*names, "_th", "_tk")
    return F.broadcast(limits) if few else limits, match


def _chooser(df: DataFrame, strata: Sequence[str], quota: Quota, key: str, seed: int, flag: str,
             hashed: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The selection over ``df`` as a function that adds ``flag`` to any table with its ``strata`` and ``key``.

    ``hashed``: a column that holds the seeded hash already, in ``df`` and where the table has it.
    """
    strata = list(strata)

    def with_hash(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_h", F.col(hashed) if hashed in rows.columns else seeded_hash(key, seed))

    hashed_rows = with_hash(df)
    limits, match = _thresholds(hashed_rows.select(*dict.fromkeys([*strata, key]), "_h"), strata, quota, key)
    # nulls order first, as in the ranking
    up_to = F.col(key).isNull() | F.coalesce(F.col(key) <= F.col("_tk"), F.lit(False))
    chosen = (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & up_to)

    def flagged(rows: DataFrame) -> DataFrame:
        base = with_hash(rows)
        return base.join(limits, on=match, how="left").select(*rows.columns, F.coalesce(chosen, F.lit(False)).alias(flag))

    return flagged


def select_smallest(df: DataFrame, strata: Sequence[str], quota: Quota, key: str, seed: int, flag: str = "selected") -> DataFrame:
    """Add boolean ``flag``: row is among the ``quota(n_stratum, n_total, n_least)``
    smallest-hash rows of its stratum.  All input rows are returned, rows with a
    null key too."""
    return _chooser(df, strata, quota, key, seed, flag)(df)


def _share(frac: float) -> Quota:
    return lambda n, N, m: F.round(F.lit(float(frac)) * n)


def _proportional(target: int) -> Quota:
    return lambda n, N, m: F.round(F.lit(float(target)) * n / N)


def stratified_split(df: DataFrame, strata: Sequence[str], test_frac: float, key: str, seed: int = 42,
                     flag: str = "is_test") -> DataFrame:
    """Exact stratified split; ``flag`` marks the test rows.

    Each stratum sends ``round(test_frac * n)`` rows (half up) to the test
    side.  The reference's Bernoulli ``sampleBy`` changes with partitioning;
    this does not.
    """
    return select_smallest(df, strata, _share(test_frac), key, seed, flag)


def split(df: DataFrame, strata: Sequence[str], test_frac: float, key: str, seed: int = 42,
          materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) as the two sides of one flagged table.

    Both sides come from the same deterministic flag, so train is exactly the
    complement of test (what the J3 anti join computes) without a second
    pass.  ``materialize=True`` writes the flagged table once to the reliable
    checkpoint folder, cutting the lineage for the many passes of model
    training that follow.
    """
    flagged = stratified_split(df, strata, test_frac, key, seed, "_is_test")
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        flagged = flagged.checkpoint(eager=True)
    return flagged.where(~F.col("_is_test")).drop("_is_test"), flagged.where("_is_test").drop("_is_test")


def sample_to(df: DataFrame, strata: Sequence[str], target: int, key: str, seed: int = 42,
              flag: str = "sampled") -> DataFrame:
    """Class-proportional sample of about ``target`` rows.

    Stratum quota = ``round(target * n / N)`` clamped to the stratum size
    (the reference fails when the data is smaller than the target).
    """
    return select_smallest(df, strata, _proportional(target), key, seed, flag)


def split_and_sample(df: DataFrame, strata: Sequence[str], test_frac: float, classes: Sequence[str], target: int, key: str,
                     split_seed: int = 42, sample_seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """E6, then E7 on the training side: (sample, test), the rows of ``split`` and ``sample_to``.

    For rows with many features: the selections are made on the keys, their hashes
    and strata alone, written once; the other columns are never written, and both
    results are map-side filters of ``df``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = df.select(*dict.fromkeys([key, *strata, *classes]), seeded_hash(key, split_seed).alias("_h_split"),
                     seeded_hash(key, sample_seed).alias("_h_sample")).checkpoint(eager=True)
    split_up = _chooser(keys, strata, _share(test_frac), key, split_seed, "_is_test", "_h_split")
    draw = _chooser(split_up(keys).where("NOT _is_test"), classes, _proportional(target), key, sample_seed, "_sampled", "_h_sample")
    flagged = split_up(df)
    sample = draw(flagged.where("NOT _is_test")).where("_sampled")
    return sample.select(*df.columns), flagged.where("_is_test").select(*df.columns)


def undersample(df: DataFrame, label: str, key: str, seed: int = 42, flag: str = "kept") -> DataFrame:
    """Every class cut to the minority-class size, without replacement."""
    return select_smallest(df, [label], lambda n, N, m: m, key, seed, flag)


def dense_index(df: DataFrame, key: str, seed: int, out: str = "idx", bits: int = 16) -> DataFrame:
    """0-based dense index in (seeded hash, key) order without a one-task window.

    Bucket counts (2**bits rows) are prefix-summed on one small table and
    broadcast (bounded by 2**bits); rows are numbered inside their bucket.
    """
    base = df.withColumn("_h", seeded_hash(key, seed)).withColumn(
        "_b", F.shiftright(F.col("_h"), HASH_BITS - bits))
    counts = base.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    # offs has at most 2**bits rows: broadcast is bounded.
    return (base.join(F.broadcast(offs), on="_b")
            .withColumn(out, F.col("_off") + rn - 1)
            .drop("_h", "_b", "_off"))


def class_counts(df: DataFrame, label: str) -> dict:
    """Per-class row counts (a K-row aggregate collected to the driver)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def bootstrap_draws(df: DataFrame, n_draws: int, key: str, seed: int, draw_col: str = "draw",
                    n_rows: int | None = None) -> DataFrame:
    """``n_draws`` rows of ``df`` drawn with replacement, seeded.

    Draw i picks the row whose dense index is ``hash(i, seed) mod n``; the
    draws and the indexed rows meet in an equi-join on that index.
    """
    indexed = dense_index(df, key, seed, "_idx")
    n = n_rows if n_rows is not None else (df.count() if n_draws > 0 else 0)
    if n == 0 or n_draws <= 0:
        return df.limit(0).withColumn(draw_col, F.lit(None).cast("bigint"))
    spark = df.sparkSession
    draws = spark.range(n_draws).select(F.col("id").alias(draw_col),
                                        F.pmod(seeded_hash("id", f"draw{seed}"), F.lit(n)).alias("_idx"))
    return draws.join(indexed, on="_idx").drop("_idx").select(*df.columns, draw_col)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42, keep_originals: bool = False,
               draw_col: str = "draw") -> DataFrame:
    """Balance every minority class up to the majority size.

    ``keep_originals=False`` (E9a, bootstrap): each minority class is replaced
    by n_major draws with replacement.  ``keep_originals=True`` (E9b): all
    originals stay and n_major - n_class draws are added.  Majority rows pass
    once.  ``draw_col`` numbers the draws (null for original rows).  Rows without
    a label are a class of their own.
    """
    counts = class_counts(df, label)
    major = max(counts, key=lambda c: (counts[c], str(c)))
    n_major = counts[major]
    parts = [df.where(F.col(label).eqNullSafe(F.lit(major))).withColumn(draw_col, F.lit(None).cast("bigint"))]
    for cls, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        if cls == major:
            continue
        minority = df.where(F.col(label).eqNullSafe(F.lit(cls)))
        if keep_originals:
            parts.append(minority.withColumn(draw_col, F.lit(None).cast("bigint")))
            parts.append(bootstrap_draws(minority, n_major - n, key, seed, draw_col, n_rows=n))
        else:
            parts.append(bootstrap_draws(minority, n_major, key, seed, draw_col, n_rows=n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class (K rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the E10 weight to every row (broadcast: one row per class)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), on=label, how="left")


def shuffle_rows(df: DataFrame, key: str, seed: int, out: str = "shuffle_key") -> DataFrame:
    """Rows in a random order that depends on the key and the seed only.

    A distributed sort by the seeded hash (``out``), ties by the key; rows of
    one key stand together.
    """
    return df.withColumn(out, seeded_hash(key, seed)).orderBy(out, key)
