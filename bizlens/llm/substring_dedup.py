"""Repeated passages by FM-indexes over content-routed shards.

A window is ``WINDOW`` consecutive words.  Streaming every document past the
index of every shard would cost documents times shards, so text is routed by
content: each window belongs to the least hash among its ``GRAM``-word grams
(its anchor), consecutive windows of one anchor form a segment, and equal
windows always meet in the shard of their anchor.

1. Anchors that occur once in the corpus cannot repeat a window: a distributed
   count removes them before any text moves.
2. Segments of the other anchors go to shards by anchor.  A shard takes whole
   anchors up to ``SHARD_SYMBOLS`` words, numbers its words, sorts suffixes and
   keeps the Burrows-Wheeler transform in a wavelet matrix of packed bits with
   block counts.  Backward search streams the windows of its segments through
   it; a window whose match covers all its words at an earlier place than its
   own is reported.  Segments stand in document order, so the earliest place is
   the least suffix in the interval.
3. An anchor of more than ``HOT_SEGMENTS`` segments (a passage that many
   documents share) would make an unbounded shard: equal segments are grouped
   first, then the windows of the distinct ones by their 128-bit hash, with
   map-side minima, and joined back.
4. Reported intervals are merged per document and the words outside them kept.

Edge cases: null text has no words; documents of fewer than ``WINDOW`` words
lose none; equal rows (same doc_id and text) are one document and all get its
result; a null doc_id orders first; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .near_dup import _G, _mix

WINDOW = 20
GRAM = 4
SLICE_CHARS = 1_000_000
SHARD_SYMBOLS = 300_000
HOT_SEGMENTS = 500


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def segments(docs_words: list[list[bytes]], window: int, gram: int):
    """(document, first word, windows, anchor) arrays of the segments of all documents, and the word hashes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    counts = np.fromiter(map(len, docs_words), np.int64, len(docs_words))
    h = np.fromiter((digest(w) for ws in docs_words for w in ws), np.uint64, int(counts.sum()))
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none
    doc = np.repeat(np.arange(len(counts)), counts)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        g = _mix(g * np.uint64(31) + h[k:k + len(g)] + _G)
    span, least, width = window - gram + 1, g, 1
    while 2 * width <= span:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    n = len(h) - window + 1
    least = np.minimum(least[:n], least[span - width:span - width + n])
    at = np.zeros(n, np.int64)
    for j in range(span - 1, -1, -1):
        same = g[j:j + n] == least
        at[same] = j
    at += np.arange(n)
    ok = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not len(ok):
        return none, none, none, none
    new = np.ones(len(ok), bool)
    new[1:] = (ok[1:] != ok[:-1] + 1) | (at[ok[1:]] != at[ok[:-1]])
    first = np.flatnonzero(new)
    start = ok[first]
    first_word = np.cumsum(counts) - counts
    return doc[start], start - first_word[doc[start]], np.diff(np.append(first, len(ok))), least[start].view(np.int64)


class WaveletMatrix:
    """Rank over a sequence of small integers: packed bits with a count a 64-bit block, one level a bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: int, pos: np.ndarray) -> np.ndarray:
        block, off = pos >> 6, (pos & 63).astype(np.uint64)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << off) - np.uint64(1)))

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of ``sym`` before ``pos``."""
        lo = np.zeros(len(pos), np.int64)
        hi = pos.astype(np.int64)
        for k in range(self.bits):
            one = (sym >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo


class FMIndex:
    """FM-index of a text of word numbers (0 separates segments), for patterns of at most 31 words."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while width < 32:  # suffixes are told apart by their first 32 words, more than any pattern has
            nxt = np.zeros(n, np.int64)
            nxt[:max(n - width, 0)] = rank[width:] + 1
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            width *= 2
        self.suffix = order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.bwt = WaveletMatrix(text[order - 1], max(int(text.max()).bit_length(), 1))

    def extend(self, lo: np.ndarray, hi: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals."""
        return self.before[sym] + self.bwt.rank(sym, lo), self.before[sym] + self.bwt.rank(sym, hi)

    def earliest(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """First place in the text of every pattern ``text[start:start + length]``."""
        out = starts.copy()
        live = np.arange(len(starts))
        lo = self.before[text[starts + length - 1]]
        hi = self.before[text[starts + length - 1] + 1]
        for k in range(length - 2, -1, -1):
            more = hi - lo > 1  # a match of one suffix is the pattern's own place
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                return out
            lo, hi = self.extend(lo, hi, text[starts[live] + k])
        out[live] = np.minimum.reduceat(np.append(self.suffix, len(text)), np.stack([lo, hi], 1).ravel())[::2]
        return out


def shard_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """(key, from, to) words of the windows that stand earlier too.

    ``rows``: (doc_id, key, start, segment) of the whole anchors of one shard.
    """
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out, seen, own, texts, numbers = [], set(), [], [], {}
    for _, key, start, seg in rows:
        if seg in seen:  # an equal segment stands earlier: all its windows do
            out.append((key, start, start + seg.count(b" ") + 1))
            continue
        seen.add(seg)
        own.append((key, start))
        texts.append([numbers.setdefault(w, len(numbers) + 1) for w in seg.split(b" ")])
    if len(own) < 1:
        return out
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.fromiter((x for t in texts for x in (*t, 0)), np.int64, int(lens.sum()) + len(lens))
    at = np.cumsum(lens + 1) - lens - 1
    n = lens - window + 1
    seg_of = np.repeat(np.arange(len(lens)), n)
    starts = at[seg_of] + np.arange(len(seg_of)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(FMIndex(text).earliest(text, starts, window) < starts)
    if not len(hit):
        return out
    # neighbouring windows merge into one interval
    new = np.ones(len(hit), bool)
    new[1:] = (seg_of[hit[1:]] != seg_of[hit[:-1]]) | (starts[hit[1:]] > starts[hit[:-1]] + window)
    first = np.flatnonzero(new)
    for a, b in zip(hit[first], hit[np.append(first[1:] - 1, len(hit) - 1)]):
        key, start = own[seg_of[a]]
        base = start - at[seg_of[a]]
        out.append((key, int(base + starts[a]), int(base + starts[b] + window)))
    return out


_RANGES = "key bigint, lo bigint, hi bigint"


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_symbols: int = SHARD_SYMBOLS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(key, lo, hi) word intervals to remove; ``docs``: (key, doc_id, text)."""

    def anchors(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, lambda t: len(t or ""), SLICE_CHARS):
                doc, _, _, h = segments([split_words(t) for t in texts[lo:hi]], window, gram)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "key": pa.array(keys[lo + doc], pa.int64())})

    def cut(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for lo, hi in slices(cols[2], lambda t: len(t or ""), SLICE_CHARS):
                words = [split_words(t) for t in cols[2][lo:hi]]
                doc, start, n, h = segments(words, window, gram)
                rows = []
                bounds = np.searchsorted(doc, np.arange(len(words) + 1))
                for d, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    cold, warm = cols[3][lo + d] or [], cols[4][lo + d] or []
                    wanted = np.concatenate([np.array(cold, np.int64), np.array(warm, np.int64)])
                    for i in a + np.flatnonzero(np.isin(h[a:b], wanted)):
                        s = int(start[i])
                        rows.append((int(h[i]), int(h[i]) in warm if warm else False, cols[1][lo + d], cols[0][lo + d], s, b" ".join(words[d][s:s + int(n[i]) + window - 1])))
                c = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("h", "hot", "doc_id", "key", "start", "seg"), c, kinds)})

    def index(batches):
        """Whole anchors (rows arrive sorted by anchor) in shards of bounded size."""
        rows, size, last = [], 0, None

        def flush():
            c = list(zip(*shard_repeats(rows, window))) or [(), (), ()]
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("key", "lo", "hi"), c)})

        for batch in batches:
            h, ids, keys, starts, segs = (c.to_pylist() for c in batch.columns)
            for x, i, k, s, seg in zip(h, ids, keys, starts, segs):
                if x != last and size >= shard_symbols:
                    yield flush()
                    rows, size = [], 0
                last, size = x, size + window
                rows.append((i, k, s, seg))
        if rows:
            yield flush()

    def windows(batches):
        import xxhash

        for batch in batches:
            out = []
            for i, k, s, seg in zip(*(c.to_pylist() for c in batch.columns)):
                words = seg.split(b" ")
                out += [(xxhash.xxh3_128_digest(b" ".join(words[o:o + window])), i, k, s + o) for o in range(len(words) - window + 1)]
            c = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("w", "doc_id", "key", "start"), c, kinds)})

    found = stored(docs.select("key", "text").mapInArrow(anchors, "h bigint, key bigint"), "anchors")
    often = found.groupBy("h").count().where("count > 1").select("h", (F.col("count") > hot).alias("hot"))
    lists = found.join(often, "h").groupBy("key").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("warm"))
    segs = stored(docs.join(lists, "key").select("key", "doc_id", "text", "cold", "warm").dropDuplicates(["key"])
                  .mapInArrow(cut, "h bigint, hot boolean, doc_id bigint, key bigint, start bigint, seg binary"), "segments")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cold = (segs.where("NOT hot").select("h", "doc_id", "key", "start", "seg").repartition(n, "h").sortWithinPartitions("h")
            .mapInArrow(index, _RANGES))
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "key", "start")
    frequent = segs.where("hot").select("doc_id", "key", "start", "seg", place.alias("p"), F.md5("seg").alias("s"))
    # a segment that stands earlier as a whole goes as a whole; the windows of the others are counted
    same = stored(frequent.join(frequent.groupBy("s").agg(F.min("p").alias("m")), "s"), "frequent")
    copies = same.where("m < p").select("key", F.col("start").alias("lo"), (F.col("start") + F.size(F.split(F.col("seg").cast("string"), " "))).alias("hi"))
    wide = same.where("m = p").select("doc_id", "key", "start", "seg").mapInArrow(windows, "w binary, doc_id bigint, key bigint, start bigint")
    wide = stored(wide.withColumn("p", place), "windows")
    least = wide.groupBy("w").agg(F.min("p").alias("m"), F.count("*").alias("n")).where("n > 1")
    warm = wide.join(least, "w").where("m < p").select("key", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))
    warm = warm.unionAll(copies.select("key", "lo", F.col("hi").cast("bigint")))
    return cold.unionAll(warm)


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, text, n_words, n_removed): words outside every repeated window, joined by one blank."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    ranges = repeated_ranges(rows, window, **options)
    spans = ranges.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def keep(batches):
        for batch in batches:
            ids, texts, spans = (c.to_pylist() for c in batch.columns)
            out, n, gone = [], [], []
            for t, sp in zip(texts, spans):
                words = split_words(t)
                left, at = [], 0
                for s in sp or ():
                    left += words[at:max(at, s["lo"])]
                    at = max(at, s["hi"])
                left += words[at:]
                out.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                n.append(len(words))
                gone.append(len(words) - len(left))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(out, pa.string()),
                                              "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        keep, "doc_id bigint, text string, n_words bigint, n_removed bigint")
