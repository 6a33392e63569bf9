"""Bulk-synchronous best-fit packing of token pieces into fixed-size sequences.

State: items (unplaced pieces) and gaps (open sequences with free places).
A round does, for all rows at once:

1. *Range-sort* items and gaps together by size (items before gaps of the same size).
2. *Successor sweep* in every range: gaps in ascending order take the largest
   unused items that fit, repeatedly.  Two items that want one gap, or two
   gaps that want one item, are settled by rank in the sort order.
3. *Carry* between ranges: what ranges leave over is matched by rank.  The
   driver sees a row of counts and sums a range, never items, and hands back
   intervals of ranks; gaps of a higher range take the largest leftovers below,
   several each when they fit by size.
4. *Open*: as many sequences as the unplaced tokens need beyond the free
   places (or one, when nothing was matched), by the largest leftovers.
5. *Update* the gaps, drop those smaller than any unplaced item, and repeat.

Every round is checkpointed to the shared folder; what reads it again takes as
many tasks as the rows ask for, whatever the number of shuffle partitions, so
neither a round nor the union of all rounds pays for small partitions.  Equal sizes are split by the
item number in the sort key, so one frequent length is spread over many ranges.

Edge cases: an item longer than the limit is an error (cut it first); items of
length 0 are not accepted (a document always has its end id); an empty table
gives an empty result; ties and repeated rows are separate items.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, slices, stored
from .tokens import SLICE_CHARS, encoder

#: Rows of a range of the sort.
RANGE_ROWS = 50_000


def token_pieces(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, limit: int = 2048) -> DataFrame:
    """Pieces of every document: only documents of more than ``limit`` ids are cut, and the first piece takes the remainder.

    A null or empty text is the end id alone.  Extra columns are ignored.
    """

    def cut(batches):
        enc = encoder(vocabulary, kind)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, len, SLICE_CHARS):
                ids, lens = enc.encode(texts[lo:hi], end_id)
                n = -(-lens // limit)
                row = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = (lens - (n - 1) * limit)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * limit)
                length = np.where(piece == 0, first, limit)
                at = (np.cumsum(lens) - lens)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_ids[lo + i] for i in row], pa.int64()), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


_SWEPT = "pid int, kind int, id bigint, size bigint, mate bigint, place bigint, rank bigint, a bigint, b bigint, c bigint, d bigint, e bigint, f bigint"
#: Kinds of swept rows; ABOUT is one row a range: items left (a), their largest (b), gaps left (c),
#: the smallest gap (d), tokens left less free places (e), items placed (f), smallest item left (size).
PLACED, ITEM_LEFT, GAP_LEFT, GAP_USED, ABOUT = range(5)


def _sweep(limit: int):
    """Sweep of one sorted range."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        size, kind, ids = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        sizes, item_ids = size[kind == 0].tolist(), ids[kind == 0].tolist()
        below = list(range(-1, len(sizes)))  # below[k + 1]: last unused item at or before k

        def unused(k: int) -> int:
            path = []
            while below[k + 1] != k:
                path.append(k + 1)
                k = below[k + 1]
            for p in path:
                below[p] = k
            return k

        rows: list[tuple] = []  # (kind, id, size, mate, place, rank)
        used = bytearray(len(sizes))
        gaps_left, least_gap, free_all = 0, None, 0
        for g, b in zip(size[kind == 1].tolist(), ids[kind == 1].tolist()):
            free = g
            while free > 0 and (k := unused(bisect.bisect_right(sizes, free) - 1)) >= 0:
                rows.append((PLACED, item_ids[k], sizes[k], b, limit - free, None))
                used[k] = 1
                below[k + 1] = k - 1
                free -= sizes[k]
            free_all += free
            if free == g:
                rows.append((GAP_LEFT, b, g, None, None, gaps_left))
                least_gap = g if least_gap is None else least_gap
                gaps_left += 1
            elif free:
                rows.append((GAP_USED, b, free, None, None, None))
        left = [k for k in range(len(sizes)) if not used[k]]
        rows += [(ITEM_LEFT, item_ids[k], sizes[k], None, None, r) for r, k in enumerate(left)]
        rows.append((ABOUT, None, sizes[left[0]] if left else None, None, None, None))
        about = (len(left), sizes[left[-1]] if left else None, gaps_left, least_gap, sum(sizes[k] for k in left) - free_all, sum(used))
        cols = dict(zip(("kind", "id", "size", "mate", "place", "rank"), zip(*rows)))
        out = {"pid": pa.array([pid] * len(rows), pa.int32())} | {n: pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in cols.items()}
        out |= {n: pa.array([None] * (len(rows) - 1) + [v], pa.int64()) for n, v in zip("abcdef", about)}
        yield pa.RecordBatch.from_pydict(out)

    return run


def _carry(left: list) -> list[tuple]:
    """Matches between ranges, as intervals of ranks: (item pid, ranks [lo, hi), items a gap, gap pid, first gap rank).

    ``left``: for every range in order its leftover items, their largest size,
    leftover gaps and the smallest gap.
    """
    out, stack = [], []
    for r in left:
        gaps, at = r["gaps"], 0
        while gaps and stack:
            pid, n, largest = stack.pop()
            each = max(1, r["least"] // largest)
            take = min(gaps, -(-n // each))
            lo = max(0, n - take * each)
            out.append((pid, lo, n, each, r["pid"], at))
            at, gaps = at + take, gaps - take
            if lo:
                stack.append((pid, lo, largest))
        if r["items"]:
            stack.append((r["pid"], r["items"], r["largest"]))
    return out


def pack(items: DataFrame, limit: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Place items (``id`` bigint, ``size`` bigint in 1..limit) into sequences: (id, sequence_id, offset).

    ``sequence_id`` is the id of the item that opened the sequence.
    """
    spark = items.sparkSession
    whole = items.where(F.col("size") == limit).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    placed = [whole]
    state = items.where(F.col("size") < limit).select("size", F.lit(0).alias("kind"), "id")
    n_rows = state.count()
    while n_rows:
        tasks = -(-n_rows // range_rows)
        ranged = state.repartitionByRange(tasks, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
        swept = checkpointed(ranged.mapInArrow(_sweep(limit), _SWEPT)).coalesce(tasks)
        about = sorted((r.asDict() for r in swept.where(F.col("kind") == ABOUT).collect()), key=lambda r: r["pid"])  # a row a range
        spans = _carry([{"pid": r["pid"], "items": r["a"], "largest": r["b"], "gaps": r["c"], "least": r["d"]} for r in about])
        left = {r["pid"]: r["a"] for r in about}
        taken = {}
        for pid, lo, hi, each, _, _ in spans:
            left[pid] -= hi - lo
            taken[pid] = taken.get(pid, 0) + -(-(hi - lo) // each)
        matched = sum(r["f"] for r in about) + sum(taken.values())
        want = max(-(-sum(r["e"] for r in about) // limit), 0 if matched else 1)
        opens = []
        for pid in sorted(left, reverse=True):  # the largest leftovers open sequences
            if (take := min(want, left[pid])) > 0:
                opens.append((pid, left[pid] - take, left[pid], 1, None, None))
                want, left[pid] = want - take, left[pid] - take
        placed.append(swept.where(F.col("kind") == PLACED).select("id", F.col("mate").alias("sequence_id"), F.col("place").alias("offset")))
        item_left = swept.where(F.col("kind") == ITEM_LEFT).select("pid", "id", "size", "rank")
        gap_left = swept.where(F.col("kind") == GAP_LEFT).select("pid", "id", "size", "rank")
        gaps = swept.where(F.col("kind") == GAP_USED).select("size", F.lit(1).alias("kind"), "id")
        # at most three intervals a range of the sort
        iv = F.broadcast(spark.createDataFrame(spans + opens, "ipid int, lo bigint, hi bigint, each bigint, gap_pid int, gap_rank bigint"))
        tagged = item_left.join(iv, (F.col("pid") == F.col("ipid")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select(
            "id", "size", "ipid", "gap_pid", (F.col("gap_rank") + F.floor((F.col("hi") - 1 - F.col("rank")) / F.col("each"))).cast("bigint").alias("gap_rank"))
        opened = tagged.where("ipid IS NOT NULL AND gap_pid IS NULL")
        placed.append(opened.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("bigint")))
        gaps = gaps.unionAll(opened.select(limit - F.col("size"), F.lit(1), "id"))
        if spans:
            mates = tagged.where("gap_pid IS NOT NULL").groupBy("gap_pid", "gap_rank").agg(F.collect_list(F.struct("id", "size")).alias("take"))  # at most limit each
            joined = gap_left.join(mates, (F.col("pid") == F.col("gap_pid")) & (F.col("rank") == F.col("gap_rank")), "left").select(
                gap_left["id"].alias("sequence_id"), gap_left["size"].alias("gap"), "take")
            joined = checkpointed(joined.coalesce(tasks))
            placed.append(joined.where("take IS NOT NULL").select("sequence_id", F.explode(F.transform("take", lambda x, i: F.struct(
                x["id"].alias("id"), (F.lit(limit) - F.col("gap") + F.aggregate(F.slice("take", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["size"])).alias("offset"))))
            ).select("col.id", "sequence_id", "col.offset"))
            gaps = gaps.unionAll(joined.select((F.col("gap") - F.coalesce(F.aggregate("take", F.lit(0).cast("bigint"), lambda a, y: a + y["size"]), F.lit(0))).alias("size"), F.lit(1), "sequence_id"))
        else:
            gaps = gaps.unionAll(gap_left.select("size", F.lit(1), "id"))
        n_items = sum(left.values())
        if not n_items:
            break
        # gaps below every item left over are full
        least = min(r["size"] for r in about if r["a"])
        state = tagged.where("ipid IS NULL").select("size", F.lit(0).alias("kind"), "id").unionAll(gaps.where(F.col("size") >= least))
        n_rows = n_items + sum(r["c"] + r["f"] for r in about) + sum(o[2] - o[1] for o in opens)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionAll(p)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, limit: int = 2048) -> DataFrame:
    """Tokenise, cut and pack documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = stored(token_pieces(docs, vocabulary, kind, end_id, limit).withColumn("id", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select("id", F.col("length").alias("size")), limit)
    return pieces.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
