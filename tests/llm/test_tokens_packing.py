"""Tokenisation, packing and token files against whole-text encoding and round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bizlens.llm.packing import _carry, pack, pack_documents
from bizlens.llm.queries import vocabulary
from bizlens.llm.token_output import BLOCK, decode_blocks, encode_blocks, pack_segment, token_table, unpack_segment
from bizlens.llm.tokens import PieceEncoder
from llm_cases import edge_rows, edges, no_docs  # noqa: F401

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
ODD = ["", "  a", "a   b", "a \n b\n\n\nc  \n", "a ", "\n", " \n", "it's 'll x", "a\xa0 b", "x\x1fy z", "<|endoftext|> a", "é ́x", "ΣΑΣ Σ İ", "\t\ta\tb\r\nc", "0 10 0", "A" * 5000]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", FILES)
@pytest.mark.parametrize("limit", [3, 10 ** 6])
def test_pieces_equal_whole_text(kind, limit):
    path = vocabulary(FILES[kind])
    enc, whole = PieceEncoder(path, kind, limit), Tokenizer.from_file(path)
    texts = ODD + [t or "" for _, t, _ in edge_rows()]
    for lo in range(0, len(texts), 7):
        ids, lens = enc.encode(texts[lo:lo + 7], 1)
        for t, got in zip(texts[lo:lo + 7], np.split(ids, np.cumsum(lens)[:-1])):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("kind", FILES)
def test_other_separators_do_not_cancel_runs(kind):
    path = vocabulary(FILES[kind])
    enc, whole = PieceEncoder(path, kind), Tokenizer.from_file(path)
    seps = ["\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000"]
    texts = ["name\tvalue\tmore\n\n", "col\xa0x\xa0y\n\n", "a\tb\tc\n\n\nd", "a\x1fb\n"]
    texts += [t.replace("~", s) for s in seps for t in ("a~b\n", "a~ b", "a~b  c", " a~b", "a~b~c \n d", "a~b~c~d\n\n\ne", "a~\nb~c")]
    ids, lens = enc.encode(texts, 1)
    for t, got in zip(texts, np.split(ids, np.cumsum(lens)[:-1])):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids + [1], t


@pytest.mark.parametrize("ids", [
    [], [0], [7] * 3000, list(range(BLOCK)), [2 ** 32 - 1, 0], [5] * 1000 + [2 ** 31] * 24 + [9],
    np.random.default_rng(0).integers(0, 50_000, 5000).tolist(), np.random.default_rng(1).geometric(0.001, 2500).tolist()])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    starts, body = encode_blocks(ids)
    assert decode_blocks(starts, body).tolist() == ids.tolist()
    lens = np.array([len(ids)])
    back, sizes = unpack_segment(pack_segment(ids, lens))
    assert back.tolist() == ids.tolist() and sizes.tolist() == lens.tolist()


def test_token_files(spark, edges, no_docs):
    path = vocabulary(FILES["word"])
    whole = Tokenizer.from_file(path)
    got = token_table(edges, path, "word", end_id=1).collect()
    assert len(got) == edges.count()
    want, at = [], 0
    for r in sorted(edges.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], len(ids), crc(ids)))
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    for k, rows in by_id.items():
        assert sorted(rows) == sorted(w for w in want if w[0] == k)
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, ascending doc_id
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert token_table(no_docs, path).count() == 0


def check_sequences(rows, limit):
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in seq.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= limit
    return len(seq)


def first_fit(sizes, limit):
    """Sequences of first-fit decreasing: the yardstick."""
    bins = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, free in enumerate(bins) if free >= s), None)
        if k is None:
            bins.append(limit - s)
        else:
            bins[k] -= s
    return len(bins)


def test_pack_documents(spark, edges, no_docs):
    path = vocabulary(FILES["byte"])
    whole = Tokenizer.from_file(path)
    limit = 512
    rows = pack_documents(edges, path, limit=limit).collect()
    n = check_sequences(rows, limit)
    assert n <= first_fit([r["length"] for r in rows], limit) * 1.03 + 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in [(r[0], r[1]) for r in edges.select("doc_id", "text").distinct().collect() if r[0] not in (None, 9)]:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i])
        assert [p[0] for p in own] == list(range(-(-len(ids) // limit)))
        assert all(p[2] == limit for p in own[1:])
        assert [(s, k, c) for _, s, k, c in own] == [(s, k, crc(ids[s:s + k])) for _, s, k, _ in own] and sum(p[2] for p in own) == len(ids)
    assert pack_documents(no_docs, path).count() == 0


@pytest.mark.parametrize("sizes", [
    [random.Random(3).randint(1, 2047) for _ in range(3000)], [10] * 5000, [1500] * 300 + [600] * 300, [1] * 2500 + [2047] * 3, [2048] * 5, [700] * 1000])
def test_pack_many_ranges(spark, sizes):
    """Few rows a range, so most matches are carried between ranges."""
    items = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint")
    got = pack(items, 2048, range_rows=200).join(items, "id").withColumnRenamed("size", "length").collect()
    assert len(got) == len(sizes) and len({r["id"] for r in got}) == len(sizes)
    n = check_sequences(got, 2048)
    assert n <= first_fit(sizes, 2048) * 1.03 + 1


def test_carry_keeps_order_and_room():
    left = [{"pid": 0, "items": 10, "largest": 5, "gaps": 0, "least": None}, {"pid": 1, "items": 3, "largest": 9, "gaps": 2, "least": 11},
            {"pid": 2, "items": 0, "largest": None, "gaps": 4, "least": 18}]
    spans = _carry(left)
    assert spans == [(0, 6, 10, 2, 1, 0), (1, 0, 3, 2, 2, 0), (0, 0, 6, 3, 2, 2)]
