"""Whole-text tokenisation inside tasks with a piece cache bounded in bytes.

Byte-pair models work piece by piece, and corpora repeat their pieces, so a
worker keeps the ids of pieces it has met, in a cache of bounded bytes.  Cuts are made only where no
pre-token of the vocabulary can cross, so the ids equal those of encoding the
whole text at once (tested against ``Tokenizer.encode``).
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of the piece cache of a worker; beyond it the cache starts anew (memory bound, not a result bound).
CACHE_BYTES = 48 << 20
#: Characters handled at a time in a worker.
SLICE_CHARS = 1_500_000

_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def cut_byte_level(text: str) -> list[str]:
    """Cut before single white space between non-spaces; other runs of white space stay inside a piece."""
    words, n = text.split(), text.count(" ") + text.count("\n")
    # all white space is blanks and line ends, and there is one of it between two words and none at the ends
    if len(words) != n + 1 or sum(map(len, words)) + n != len(text):
        return _SAFE_CUT.split(text)
    return text.replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split("\x1f")


def cut_words(text: str) -> list[str]:
    """Cut at blanks and line ends, which the word vocabulary drops.

    The vocabulary lowers letters itself; doing so first for Latin-1 texts, where
    every implementation agrees, lets capitals share cache entries.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


CUTTERS = {"byte": cut_byte_level, "word": cut_words}
#: A text that is one token of its own, and how it stands between two pieces.
MARKS = {"byte": ("\n", "\n"), "word": ("0", " 0 ")}


class PieceEncoder:
    """Ids of texts by a tokenizers file; ``kind`` names the cutter."""

    def __init__(self, path: str, kind: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cut, self.limit = Tokenizer.from_file(path), CUTTERS[kind], cache_bytes
        self.kind = kind
        self._reset()

    def _reset(self) -> None:
        # sorted 64-bit hashes of the known pieces and their numbers: some 25 bytes a piece, where a dict takes 200
        self.keys, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _ids(self, pieces: list[str]):
        """Yield (places, flat ids, ids per piece).  Plain pieces are encoded many at
        a time, with a mark between them that is a token of its own; others one by one."""
        mark, text = MARKS[self.kind]
        (mark_id,) = self.tok.encode(mark, add_special_tokens=False).ids
        plain, rest = [], []
        for i, p in enumerate(pieces):
            q = p[1:] if p[:1] == " " else p
            (plain if q and mark not in p and q == q.strip() else rest).append(i)
        for lo in range(0, len(plain), 1000):
            part = plain[lo:lo + 1000]
            ids = np.array(self.tok.encode_batch_fast([text.join([pieces[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == mark_id)
            if len(at) == len(part) - 1:
                yield part, np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            else:
                rest += part
        for lo in range(0, len(rest), 1000):
            part = rest[lo:lo + 1000]
            ids = [e.ids for e in self.tok.encode_batch([pieces[i] for i in part], add_special_tokens=False)]
            yield part, np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Number the pieces after those already known; the number of each."""
        numbers, n = np.empty(len(pieces), np.int32), len(self.keys)
        for places, flat, lens in self._ids(pieces):
            total = len(flat)
            while n + len(lens) > len(self.starts):
                self.starts, self.lens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens))
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:self.used + total] = flat
            self.lens[n:n + len(lens)] = lens
            self.starts[n:n + len(lens)] = self.used + np.cumsum(lens) - lens
            numbers[places] = np.arange(n, n + len(lens))
            self.used, n = self.used + total, n + len(lens)
        return numbers

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """Number of every piece; new ones are learnt."""
        if 24 * len(self.starts) + self.flat.nbytes > self.limit:  # keys, codes, starts and lengths, and the ids
            self._reset()
        hashes, first, inverse = np.unique(np.fromiter(map(hash, pieces), np.int64, len(pieces)), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        codes = np.empty(len(hashes), np.int32)
        codes[known] = self.codes[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            codes[new] = self._learn([pieces[i] for i in first[new]])
            self.keys, self.codes = np.insert(self.keys, at[new], hashes[new]), np.insert(self.codes, at[new], codes[new])
        return codes[inverse]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with ``end_id`` after every text, ids per text)."""
        pieces: list[str] = []
        counts = []
        for t in texts:
            own = self.cut(t)
            counts.append(len(own))
            pieces += own
        codes = self._codes(pieces)
        lens = self.lens[codes].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        src = np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(total)
        per = np.concatenate([[0], ends])[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        out = np.insert(self.flat[src].astype(np.uint32), per, np.uint32(end_id)) if counts else np.zeros(0, np.uint32)
        return out, np.diff(np.concatenate([[0], per])) + 1


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary, so that its tasks share the bounded cache; another vocabulary takes its place."""
    key = (os.getpid(), path, kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, kind)
    return _ENCODERS[key]
