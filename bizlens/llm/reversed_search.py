"""Ranked lexical search turned around: the index is of the items, the documents stream.

Every item (query) gets its ``k`` best documents by a BM25-like integer score:
a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), and a document with
``tf`` of it adds weight * (10^9 tf div (1000 tf + 8 m)) for every time the
item holds the term, m = 25 + 75 n N div L.

1. *Blocks of items*: items are dealt into blocks of at most ``BLOCK_TERMS``
   distinct (item, term) pairs, or one item.  The index of a block, term ->
   items, is what is broadcast; its size is bounded by the block.
2. *Counting pass*: each task streams documents, counts their terms and
   writes, per document, the counts of the block's terms; the same pass sums
   N, L and every term's document frequency over all documents.
3. *Scoring pass*: each task streams the written counts through the index and
   keeps ``k`` entries per item; a document is only looked at by items that it
   can still enter.
4. *Merge*: heaps are merged in two steps, first those of up to 256 tasks each,
   so no group holds more than the entries of that many tasks.

Terms are runs of ASCII letters, digits and characters beyond ASCII, of which
only A-Z are lowered.  Equal scores go by ascending doc_id, nulls last.

Edge cases: null and empty texts have no terms and are in no result; an item
without terms, or that no document shares a term with, has no rows; rows of
items are items of their own, whatever their ids; repeated documents are
documents of their own; long texts are counted a slice at a time; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Most (item, term) pairs of a block's index, unless one item has more.
BLOCK_TERMS = 250_000
#: Bytes of a text that are counted at a time.
SLICE_BYTES = 4_000_000
#: Postings and score cells that are worked on at a time.
STEP = 2_000_000
#: Tasks whose heaps are merged first.
MERGE = 256

#: Bytes of terms stay (A-Z lowered); all others are blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text and how often each stands there."""
    text = text.translate(_TABLE)
    counts: Counter = Counter()
    lo = 0
    while lo < len(text):
        hi = lo + SLICE_BYTES
        if hi < len(text):
            cut = text.find(b" ", hi)
            hi = len(text) if cut < 0 else cut
        counts.update(text[lo:hi].split())
        lo = hi
    return counts


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times): the distinct terms of every item; ``item`` numbers the rows."""
    def run(batches):
        for batch in batches:
            rows = [(n, i, t, k) for n, i, b in zip(*(batch.column(c).to_pylist() for c in range(3))) for t, k in sorted(term_counts(b).items())]
            for lo in range(0, len(rows), 100_000):
                cols = list(zip(*rows[lo:lo + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())],
                                                 names=["item", "item_id", "term", "times"])

    rows = items.where(F.col(f"`{text}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return map_batches(rows, run, "item bigint, item_id bigint, term binary, times bigint")


def item_blocks(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``terms`` with ``block``: at most ``block_terms`` rows, or one item."""
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    parts = -(-terms.count() // block_terms)
    # items are dealt to parts, and each part is cut by its running sum, so parts are bounded when shared out
    sizes = sizes.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(max(1, parts))))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("item"))
    sizes = sizes.select("item", "part", "n", upto.alias("upto")).select("item", F.struct("part", F.expr(f"(upto - 1) div {int(block_terms)}").alias("cut")).alias("slot"), "n")
    # the first item of a slot may begin before it: an item beyond the bound stands alone, and what runs over the bound is split off
    running = F.sum("n").over(Window.partitionBy("slot").orderBy("item"))
    sizes = sizes.withColumn("over", F.when(F.col("n") > block_terms, F.col("item")).when(running > block_terms, F.lit(-1)))
    return terms.join(sizes.select("item", F.to_json(F.struct("slot", "over")).alias("block")), "item")


class Index:
    """Postings of a block of items, as arrays: term number -> (local item, times)."""

    def __init__(self, table: pa.Table):
        items, terms, times = (table.column(c).to_pylist() for c in ("item", "term", "times"))
        self.items = sorted(set(items))
        place = {x: k for k, x in enumerate(self.items)}
        self.number = {t: k for k, t in enumerate(sorted(set(terms)))}
        rows = sorted((self.number[t], place[i], q) for i, t, q in zip(items, terms, times))
        self.post = np.array([r[1] for r in rows], np.int64)
        self.times = np.array([r[2] for r in rows], np.int64)
        self.start = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(self.number) + 1))


_COUNTED = "doc_id bigint, n bigint, terms binary, tfs binary, term int, df bigint, n_docs bigint, n_terms bigint"


def _count(index):
    """Counting pass: a row a document that holds a term of the block, then the task's sums."""
    def run(batches):
        number = index.value.number
        df, n_docs, n_terms = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = term_counts(text)
                n = counts.total()
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                own = [(number[t], k) for t, k in counts.items() if t in number]
                if own:
                    at, tf = np.array(own, np.int64).T
                    df[at] += 1
                    rows.append((doc_id, n, at.astype("<i4").tobytes(), tf.astype("<i8").tobytes()))
            if rows:
                cols = list(zip(*rows))
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()),
                     pa.array(none, pa.int32()), *(pa.array(none, pa.int64()) for _ in range(3))], names=[c.split()[0] for c in _COUNTED.split(", ")])
        at = np.flatnonzero(df)
        none = [None] * (len(at) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary()),
             pa.array([*at.tolist(), None], pa.int32()), pa.array([*df[at].tolist(), None], pa.int64()),
             pa.array([*none[1:], n_docs], pa.int64()), pa.array([*none[1:], n_terms], pa.int64())], names=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


def _scores(index: Index, weight: np.ndarray, n_docs: int, n_terms: int, n: list, terms: list, tfs: list):
    """Yield (first document, scores): an array documents x items, a step of documents at a time."""
    at = [np.frombuffer(b, "<i4") for b in terms]
    width = np.array([int((index.start[a + 1] - index.start[a]).sum()) for a in at])
    cells, lo = len(index.items), 0
    while lo < len(at):
        hi, total = lo + 1, int(width[lo])
        while hi < len(at) and total + width[hi] <= STEP and (hi - lo + 1) * cells <= STEP:
            total, hi = total + int(width[hi]), hi + 1
        part = np.concatenate(at[lo:hi])
        tf = np.concatenate([np.frombuffer(b, "<i8") for b in tfs[lo:hi]])
        own = [len(a) for a in at[lo:hi]]
        m = np.repeat(np.array([25 + 75 * x * n_docs // n_terms for x in n[lo:hi]], np.int64), own)
        gain = weight[part] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        lens = index.start[part + 1] - index.start[part]
        ends = np.cumsum(lens)
        src = np.repeat(index.start[part] - (ends - lens), lens) + np.arange(total)
        doc = np.repeat(np.repeat(np.arange(hi - lo), own), lens)
        out = np.zeros((hi - lo) * cells, np.int64)
        np.add.at(out, doc * cells + index.post[src], np.repeat(gain, lens) * index.times[src])
        yield lo, out.reshape(hi - lo, cells)
        lo = hi


def _rank(index, stats, k: int):
    """Scoring pass: the task's ``k`` best documents of every item."""
    def run(batches):
        from pyspark import TaskContext

        weight, n_docs, n_terms = stats.value
        own = index.value
        heaps: list[list] = [[] for _ in own.items]  # ascending (-score, null id, id)
        floor = np.zeros(len(own.items), np.int64)  # the score that a document must reach
        last = np.full(len(own.items), np.iinfo(np.int64).max, np.int64)  # at that score, the id that it must be below
        for batch in batches:
            ids, n, terms, tfs = (batch.column(c).to_pylist() for c in range(4))
            key = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
            for lo, scores in _scores(own, weight, n_docs, n_terms, n, terms, tfs):
                docs = key[lo:lo + len(scores), None]
                hit = (scores > 0) & ((scores > floor) | ((scores == floor) & (docs <= last)))
                for d, i in zip(*(a.tolist() for a in np.nonzero(hit))):
                    heap, doc_id = heaps[i], ids[lo + d]
                    entry = (-int(scores[d, i]), doc_id is None, doc_id or 0)
                    if len(heap) < k or entry < heap[-1]:
                        bisect.insort(heap, entry)
                        del heap[k:]
                        if len(heap) == k:
                            floor[i], last[i] = -heap[-1][0], np.iinfo(np.int64).max if heap[-1][1] else heap[-1][2]
        rows = [(own.items[i], None if null else d, -s) for i, heap in enumerate(heaps) for s, null, d in heap]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())],
                                             names=["item", "doc_id", "score", "task"])

    return run


def _best(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 10,
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``."""
    spark = docs.sparkSession
    terms = stored(item_terms(items, item_id, text), "search-terms")
    blocks = stored(item_blocks(terms, block_terms), "search-blocks")
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = []
    for (block,) in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        # at most block_terms rows, or one item's
        index = spark.sparkContext.broadcast(Index(blocks.where(F.col("block") == block).select("item", "term", "times").toArrow()))
        counted = stored(map_batches(texts, _count(index), _COUNTED), "search-counts")
        n_docs, n_terms = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            index.unpersist()
            continue
        # a row a term of the block
        df = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weight = np.zeros(len(index.value.number), np.int64)
        for t, x in zip(df.column("term").to_pylist(), df.column("df").to_pylist()):
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1)))
        stats = spark.sparkContext.broadcast((weight, n_docs, n_terms))
        heaps = map_batches(counted.where("n IS NOT NULL").select("doc_id", "n", "terms", "tfs"), _rank(index, stats, k), "item bigint, doc_id bigint, score bigint, task int")
        found.append(stored(heaps, "search-heaps"))
        index.unpersist()
        stats.unpersist()
    if not found:
        return spark.createDataFrame([], "item bigint, item_id bigint, rank int, doc_id bigint, score bigint")
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionAll(f)
    first = _best(rows.withColumn("lot", F.expr(f"task div {MERGE}")), ["item", "lot"], k).drop("rank")
    best = _best(first, ["item"], k)
    names = terms.select("item", "item_id").distinct()
    return best.join(names, "item").select("item", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB twin: every document's score for every item.
SQL = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
dn AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dn),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term),
g AS (SELECT tf.r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS gain FROM tf JOIN dn USING (r) JOIN w USING (term), s),
q AS (SELECT i, item_id, term, count(*) AS times
      FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY i, item_id, term),
p AS (SELECT i, item_id, r, doc_id, CAST(sum(gain * times) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
