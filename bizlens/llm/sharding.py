"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law ``rows``: the shard sizes differ by one row at most, and every assignment
of rows to (shard, slot) with these sizes is equally likely.

1. *Blocks*: the input is written once with a row number; a block is at most
   ``BLOCK_ROWS`` consecutive rows of one input partition.
2. *Communication matrix*: how many rows of each block go to each shard.  Its
   row sums are the block sizes and its column sums the shard sizes, and it is
   drawn from the multivariate hypergeometric distribution, top down in a tree
   of fan-out 256 over the blocks: a node deals its shard capacities out to its
   children, child by child and shard by shard.  A draw is exact inversion when
   few outcomes are possible and rejection by ratio of uniforms otherwise.
3. *Permute locally*: the rows of a block are numbered in a random order, and
   the block's line of the matrix cuts that order into shards.
4. *Exchange and permute again*: inside a shard, rows are dealt to bins by
   random bits; a bin's first slot is the count of the bins before it, and the
   rows of a bin are numbered in a random order.

All random numbers are hashes of the seed and of written row numbers, so a
recomputed task repeats them.  A group of copies is rows like any others: it
is spread over blocks, shards and bins.

Edge cases: nulls, equal and repeated rows are ordinary rows; an empty table
gives an empty result; fewer rows than shards leave shards empty; columns named
like an added one are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: Most rows of a block, and about the rows of a bin.
BLOCK_BITS = 16
BLOCK_ROWS = 1 << BLOCK_BITS
#: log2 of the children of a node of the tree over blocks.
FAN_BITS = 8
#: Outcomes up to which a draw inverts the distribution.
FEW = 40
#: Tries of the rejection; each accepts with probability of over 0.6, so all fail once in 1e40 draws.
TRIES = 100
ADDED = ("shard", "slot")

_long = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*key: Column) -> Column:
    """A number inside (0, 1), fixed by the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _ln_factorial(x: Column) -> Column:
    d = x.cast("double")
    stirling = (d + 0.5) * F.log(d) - d + 0.9189385332046727 + _tail(d)
    return F.when(x < 16, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def _tail(d: Column) -> Column:
    return 1.0 / (12.0 * d) - 1.0 / (360.0 * d * d * d)


def _ln_factorial_ratio(x: Column, y: Column) -> Column:
    """ln(x! / y!); for large numbers without the loss of a difference of two large logarithms."""
    a, b = x.cast("double"), y.cast("double")
    close = (a + 0.5) * F.log1p((a - b) / b) + (a - b) * (F.log(b) - 1.0) + _tail(a) - _tail(b)
    return F.when(F.least(x, y) < 16, _ln_factorial(x) - _ln_factorial(y)).otherwise(close)


def _invert(p: Column, u: Column) -> Column:
    """Draw from {0..hi} by cumulated weights; ``p`` has few, many, drawn (at most half of the urn) and hi."""
    few, many, drawn, hi = (p[c] for c in ("few", "many", "drawn", "hi"))

    def weights(acc, k):
        last = F.element_at(acc, -1)
        ratio = ((few - k + 1) * (drawn - k + 1)).cast("double") / (k * (many - drawn + k)).cast("double")
        return F.concat(acc, F.array(last * ratio))

    # with hi = 0 there is no step: the only outcome is 0
    ws = F.aggregate(F.when(hi > 0, F.sequence(F.lit(1).cast("bigint"), hi)).otherwise(F.array().cast("array<bigint>")), F.array(F.lit(1.0)), weights)

    def walk(ws):
        total = F.aggregate(ws, F.lit(0.0), lambda a, w: a + w)
        return F.least(hi, F.aggregate(ws, F.struct((u * total).alias("rest"), _long(0).alias("k"), F.lit(False).alias("done")), lambda a, w: F.when(
            a["done"] | (a["rest"] < w), F.struct(a["rest"].alias("rest"), a["k"].alias("k"), F.lit(True).alias("done"))).otherwise(
            F.struct((a["rest"] - w).alias("rest"), (a["k"] + 1).alias("k"), F.lit(False).alias("done"))))["k"])

    return _let(ws, walk)


def _reject(p: Column, key: list[Column]) -> Column:
    """Draw by ratio of uniforms (table mountain hat of Stadlober, 1989) around the mode."""
    few, many, drawn, hi = (p[c] for c in ("few", "many", "drawn", "hi"))
    share = few.cast("double") / (few + many).cast("double")
    centre = drawn.cast("double") * share + 0.5
    sd = F.sqrt((few + many - drawn).cast("double") * drawn.cast("double") * share * (1.0 - share) / (few + many - 1).cast("double") + 0.5)
    width = 1.7155277699214135 * sd + 0.8989161620588988
    mode = F.floor((drawn + 1).cast("double") * (few + 1).cast("double") / (few + many + 2).cast("double"))
    hat = F.struct(centre.alias("centre"), width.alias("width"), mode.alias("mode"), F.least((hi + 1).cast("double"), F.floor(centre + 16.0 * sd).cast("double")).alias("end"))

    def tries(h):
        def one(acc, i):
            def judge(uw):
                def ratio(z):
                    t = (_ln_factorial_ratio(h["mode"], z) + _ln_factorial_ratio(few - h["mode"], few - z)
                         + _ln_factorial_ratio(drawn - h["mode"], drawn - z) + _ln_factorial_ratio(many - drawn + h["mode"], many - drawn + z))
                    return F.when(2.0 * F.log(uw["u"]) <= t, z)
                return F.when((uw["w"] >= 0.0) & (uw["w"] < h["end"]), _let(F.floor(uw["w"]), ratio))

            u = _uniform(*key, i, F.lit("x"))
            w = h["centre"] + h["width"] * (_uniform(*key, i, F.lit("y")) - 0.5) / u
            return F.when(acc.isNotNull(), acc).otherwise(_let(F.struct(u.alias("u"), w.alias("w")), judge))

        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("bigint"), one), h["mode"])

    return _let(hat, tries)


def hypergeometric(good: Column, bad: Column, n: Column, *key: Column) -> Column:
    """How many of ``n`` rows drawn from ``good`` + ``bad`` are good; bigints, ``n`` at most their sum."""
    few, many, drawn = F.least(good, bad), F.greatest(good, bad), F.least(n, good + bad - n)
    p = F.struct(few.alias("few"), many.alias("many"), drawn.alias("drawn"), F.least(few, drawn).alias("hi"))

    def back(z):
        z = F.when(good > bad, F.least(n, good + bad - n) - z).otherwise(z)
        return F.when(n > good + bad - n, good - z).otherwise(z)

    return _let(_let(p, lambda p: F.when(p["hi"] <= FEW, _invert(p, _uniform(*key, F.lit("u")))).otherwise(_reject(p, list(key)))), back)


def deal(capacity: Column, n: Column, n_shards: int, *key: Column) -> Column:
    """How many of ``n`` rows go to each shard when ``capacity`` (array) has sum ``n`` or more: multivariate hypergeometric."""
    total = F.aggregate(capacity, _long(0), lambda a, c: a + c)

    def one(acc, s):
        good = F.element_at(capacity, s)
        draw = hypergeometric(good, acc["pool"] - good, acc["n"], *key, s)
        return _let(draw, lambda x: F.struct((acc["n"] - x).alias("n"), (acc["pool"] - good).alias("pool"), F.concat(acc["xs"], F.array(x)).alias("xs")))

    start = F.struct(_long(n).alias("n"), total.alias("pool"), F.array().cast("array<bigint>").alias("xs"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, one)["xs"]


def _fold(n_shards: int, seed: int, level: int):
    """Step of dealing a node's capacities out to its children."""
    def fold(acc, c):
        return _let(deal(acc["left"], c["n"], n_shards, F.lit(seed), F.lit(level), c["node"]), lambda x: F.struct(
            F.zip_with(acc["left"], x, lambda a, b: a - b).alias("left"),
            F.concat(acc["out"], F.array(F.struct(c["node"].alias("node"), c["n"].alias("n"), x.alias("counts")))).alias("out")))

    return fold


def communication_matrix(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, n, counts): exact rows of each block per shard.  ``blocks``: (block bigint >= 0, n bigint), unique, written."""
    total, top = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("block"), F.lit(0))).first()
    levels = [blocks.select(F.col("block").alias("node"), "n")]
    while top >> (FAN_BITS * (len(levels) - 1)):
        up = levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(stored(up, "shard-level"))
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    dealt = levels[-1].select("node", "n", F.array(*[_long(c) for c in sizes]).alias("counts"))
    for level in range(len(levels) - 2, -1, -1):
        children = levels[level].groupBy(F.shiftright("node", FAN_BITS).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children"))  # at most 2 ** FAN_BITS

        start = F.struct(F.col("counts").alias("left"), F.array().cast("array<struct<node:bigint,n:bigint,counts:array<bigint>>>").alias("out"))
        dealt = stored(dealt.join(children, F.col("node") == F.col("parent")).select(
            F.explode(F.aggregate("children", start, _fold(n_shards, seed, level))["out"]).alias("c")).select("c.node", "c.n", "c.counts"), "shard-matrix")
    return dealt.withColumnRenamed("node", "block")


def shuffle_into_shards(rows: DataFrame, n_shards: int = 16, seed: int = 13) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to n_shards - 1) and ``slot`` (bigint, gapless from 0 in a shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc")
    snap = stored(rows.select(whole, F.monotonically_increasing_id().alias("row")), "shard-rows")
    block = F.shiftright("row", BLOCK_BITS).alias("block")  # the upper bits of a row number name its input partition
    blocks = stored(snap.groupBy(block).agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    matrix = communication_matrix(blocks, n_shards, seed)
    # permute locally, then cut the order by the block's line of the matrix
    local = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row"))
    ends = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), _long(0), lambda a, c: a + c))
    sent = snap.select("row", block).withColumn("place", local).join(matrix.select("block", ends.alias("ends")), "block")
    sent = stored(sent.select("row", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard")), "shard-sent")
    # permute again: bins by random bits, a random order in each
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, (total // (n_shards * BLOCK_ROWS)).bit_length())
    again = sent.withColumn("draw", F.xxhash64(F.lit(seed), F.lit("again"), "row"))
    again = again.withColumn("bin", F.shiftrightunsigned("draw", 64 - bits) if bits else _long(0))
    bins = again.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))  # a row for some BLOCK_ROWS rows
    first = (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("first")
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("draw", "row"))
    slots = again.withColumn("place", place).join(bins.select("shard", "bin", first), ["shard", "bin"]).select(
        "row", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
    return snap.join(slots, "row").select(*[F.col(f"doc.`{c}`").alias(c) for c in rows.columns if c not in ADDED], "shard", "slot")


def write_shards(rows: DataFrame, path: str | None = None, n_shards: int = 16, seed: int = 13) -> str:
    """Write the shards as Parquet below ``path``/shard=N, rows in slot order; returns the folder.

    A shard is as many files as it needs tasks: files follow each other in slot order.
    """
    path = path or fresh_path(rows.sparkSession, "shards")
    dealt = shuffle_into_shards(rows, n_shards, seed)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def digest(docs: DataFrame, n_shards: int = 16, seed: int = 13) -> DataFrame:
    """Where every document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text (null: none) and one; ``grown_shard``
    is null, as the law ``rows`` makes no promise on growth.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
