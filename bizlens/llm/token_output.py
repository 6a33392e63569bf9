"""Token-ID output: patched frame-of-reference segments written and read with Spark.

A segment is one binary value (little-endian) holding whole documents in
ascending ``doc_id`` order::

    magic "PFR1" | n_docs u32 | n_ids u64 | n_blocks u32
    doc lengths u64 * n_docs
    block index: byte start u64 * n_blocks   (from the first block)
    blocks: minimum u32 | width u8 | n u16 | n_exceptions u16
            packed (id - minimum) bits, ``width`` each, low bit first
            exception places u16, exception values u32

A block takes ``BLOCK`` ids.  Its width is the smallest that holds the chosen
percentile of the ids less the block minimum; ids that need more bits keep
their low bits in place and stand whole in the exception list.

Segments are rows of a Parquet table (``part``, ``seg``, ``local_start``,
``doc_ids``, ``n_ids``, ``content``): parts are the ranges of the distributed sort, so (part, seg) is
ascending doc_id order.  Only per-part totals (one row a partition) reach the driver.

Edge cases: a null or empty text is a document of the end id alone; repeated
doc_ids are separate documents; an empty table writes no segment; a null doc_id
sorts first; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, slices
from .tokens import SLICE_CHARS, encoder

MAGIC = b"PFR1"
BLOCK = 1024
#: Share of a block's ids that the packed width must hold.
PERCENTILE = 0.98
#: Ids after which a segment is closed (whole documents, so a longer document makes a longer segment).
SEGMENT_IDS = 500_000
_BLOCK_HEAD = struct.Struct("<IBHH")


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(byte start of every block, the blocks) of a run of u32 ids."""
    n_blocks = -(-len(ids) // BLOCK)
    out: list[bytes] = [b""] * n_blocks
    full = len(ids) // BLOCK
    groups = [(np.arange(full), ids[:full * BLOCK].reshape(full, BLOCK))] if full else []
    if full < n_blocks:
        groups.append((np.array([full]), ids[full * BLOCK:].reshape(1, -1)))
    for at, rows in groups:
        n = rows.shape[1]
        low = rows.min(axis=1)
        rest = rows - low[:, None]
        need = _bits(rest)
        width = np.sort(need, axis=1)[:, min(n - 1, int(np.ceil(PERCENTILE * n)) - 1)]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            part = rest[own]
            if w:
                bits = np.unpackbits(np.ascontiguousarray(part, dtype="<u4").view(np.uint8).reshape(len(own), n, 4), axis=2, count=int(w), bitorder="little")
                packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            for j, b in enumerate(own):
                places = np.flatnonzero(need[b] > w)
                out[at[b]] = b"".join((
                    _BLOCK_HEAD.pack(int(low[b]), int(w), n, len(places)),
                    packed[j].tobytes() if w else b"",
                    places.astype("<u2").tobytes(), rest[b][places].astype("<u4").tobytes()))
    sizes = np.fromiter(map(len, out), np.int64, n_blocks)
    return np.cumsum(sizes) - sizes, b"".join(out)


def decode_blocks(starts: np.ndarray, body: bytes) -> np.ndarray:
    """The ids of ``encode_blocks``."""
    heads = [_BLOCK_HEAD.unpack_from(body, int(s)) for s in starts]
    if not heads:
        return np.zeros(0, np.uint32)
    out = np.empty((len(heads), BLOCK), np.uint32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, n, _x) in enumerate(heads):
        kinds.setdefault((w, n), []).append(i)
    raw = np.frombuffer(body, np.uint8)
    for (w, n), own in kinds.items():
        size = (w * n + 7) // 8
        if w:
            at = starts[own].astype(np.int64)[:, None] + _BLOCK_HEAD.size + np.arange(size)
            bits = np.unpackbits(raw[at], axis=1, count=w * n, bitorder="little").reshape(len(own), n, w)
            wide = np.zeros((len(own), n, 4), np.uint8)
            small = np.packbits(bits, axis=2, bitorder="little")
            wide[:, :, :small.shape[2]] = small
            out[own, :n] = wide.reshape(len(own), n * 4).view("<u4")
        else:
            out[own, :n] = 0
    for i, (low, w, n, x) in enumerate(heads):
        if x:
            at = int(starts[i]) + _BLOCK_HEAD.size + (w * n + 7) // 8
            out[i, np.frombuffer(body, "<u2", x, at)] = np.frombuffer(body, "<u4", x, at + 2 * x)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    last = heads[-1][2]
    return out.reshape(-1)[:(len(heads) - 1) * BLOCK + last]


def pack_segment(ids: np.ndarray, lens: np.ndarray) -> bytes:
    starts, body = encode_blocks(ids)
    return b"".join((MAGIC, struct.pack("<IQI", len(lens), len(ids), len(starts)),
                     lens.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), body))


def unpack_segment(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per document) of a segment."""
    if content[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks = struct.unpack_from("<IQI", content, 4)
    at = 20
    lens = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
    starts = np.frombuffer(content, "<u8", n_blocks, at + 8 * n_docs)
    ids = decode_blocks(starts, content[at + 8 * (n_docs + n_blocks):])
    if len(ids) != n_ids or lens.sum() != n_ids:
        raise ValueError("token segment is damaged")
    return ids, lens


SEGMENT_SCHEMA = "part int, seg int, local_start bigint, doc_ids array<bigint>, n_ids bigint, content binary"


def write_tokens(docs: DataFrame, vocabulary: str, kind: str, end_id: int, path: str,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts and write segments in ascending doc_id order to ``path``."""

    def encode(batches):
        from pyspark import TaskContext

        part, seg, local = TaskContext.get().partitionId(), 0, 0
        enc = encoder(vocabulary, kind)
        held_ids, held_lens, held_docs, n = [], [], [], 0

        def segment():
            ids = np.concatenate(held_ids)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()),
                "local_start": pa.array([local], pa.int64()),
                "doc_ids": pa.array([held_docs], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()),
                "content": pa.array([pack_segment(ids, np.concatenate(held_lens))], pa.binary())})

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, len, SLICE_CHARS):
                ids, lens = enc.encode(texts[lo:hi], end_id)
                held_ids.append(ids)
                held_lens.append(lens)
                held_docs += doc_ids[lo:hi]
                n += len(ids)
                if n >= segment_ids:
                    yield segment()
                    seg, local, held_ids, held_lens, held_docs, n = seg + 1, local + n, [], [], [], 0
        if held_docs:
            yield segment()

    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    map_batches(rows, encode, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written segments."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a partition
    before, at = [], 0
    for r in totals:
        before.append((r["part"], at))
        at += r["n"]
    base = spark.createDataFrame(before, "part int, before bigint")

    def decode(batches):
        for batch in batches:
            for docs, content, start in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids, lens = unpack_segment(content.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + ends - lens, pa.int64()),
                    "n_tokens": pa.array(lens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return (files.join(F.broadcast(base), "part").select("doc_ids", "content", (F.col("before") + F.col("local_start")).alias("start"))
            .mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_table(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the token files and return the per-document digest read back from them."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, kind, end_id, path)
    return read_tokens(docs.sparkSession, path)
