"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case as their runs of word characters joined by one
blank.  An item of n such characters may stand in a document with at most
``n * error_rate`` edits (insertions, deletions, substitutions).  It is split
into one piece more than its error budget, so one piece stands there unchanged:

1. An Aho-Corasick automaton over the pieces finds every exact piece hit in the whole text.
2. Each hit gives a window where the item would stand; overlapping windows of an item are merged.
3. Myers' bit-parallel algorithm computes the least edit distance of the item in each window.

Items of fewer than ``min_chars`` characters are searched as well, without edits
and on word borders only, since an edit would turn them into ordinary text.  Of a
short formula or piece of code little is left without its signs: where they are
at least a third of it, white space aside, the item is compared with all its
characters, in lower case with runs of white space as one blank.  A short item that is an ordinary
phrase therefore finds every document that holds the phrase; callers who do not
want that take such items out of ``benchmark``.

Items go to the tasks in blocks of bounded size (``block_chars``; the documents
are read once a block), whatever the size of the benchmark.

Edge cases: null, empty and blank texts match nothing, nor do such items; repeated
documents and repeated items each give their own rows; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_WORD = re.compile(r"\w+")
ERROR_RATE = 1 / 16
MIN_CHARS = 32
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def signs(text: str | None) -> str:
    """The text with its signs: lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float) -> int:
    return int(n * rate)


class Item(NamedTuple):
    """An item as it is searched: in the signs form or the normal one, with ``errors`` edits, or exactly on word borders."""

    item_id: int
    text: str
    errors: int
    exact: bool
    signs: bool


def prepare(item_id: int, text: str | None, rate: float, min_chars: int) -> Item | None:
    """The form in which an item is searched; None for a blank one."""
    plain, whole = normal(text), signs(text)
    if not whole:
        return None
    if len(plain) >= min_chars:
        return Item(item_id, plain, budget(len(plain), rate), False, False)
    if 3 * len(plain.replace(" ", "")) <= 2 * len(whole.replace(" ", "")):
        return Item(item_id, whole, 0, True, True)
    return Item(item_id, plain, 0, True, False)


def on_borders(text: str, a: int, b: int) -> bool:
    """Whether ``text[a:b]`` cuts no word at its ends."""
    def inside(i: int) -> bool:
        return 0 < i < len(text) and bool(_WORD.match(text[i - 1])) and bool(_WORD.match(text[i]))

    return not inside(a) and not inside(b)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces (place, text) of nearly equal length."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, end of the first such part); distance most + 1 if above ``most``."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, most + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        #: the form of the texts and an automaton over the pieces of the items in that form; only what the block needs
        self.autos = [(form, self._automaton([k for k, i in enumerate(items) if i.signs == kind])) for kind, form in ((False, normal), (True, signs))
                      if any(i.signs == kind for i in items)]

    def _automaton(self, own: list[int]):
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for k in own:
            for at, p in pieces(self.items[k].text, self.items[k].errors):
                places.setdefault(p, []).append((k, at))
        auto = ahocorasick.Automaton()
        for p, hits in places.items():
            auto.add_word(p, (len(p), hits))
        auto.make_automaton()
        return auto

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, errors allowed, end in the searched form of the text) of every item that stands in the text."""
        return [f for form, auto in self.autos for f in self._search(auto, form(text))]

    def _search(self, auto, text: str) -> list[tuple[int, int, int, int]]:
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (n, own) in auto.iter(text):
            for k, at in own:
                item = self.items[k]
                if item.exact:
                    if k not in exact and on_borders(text, end + 1 - n, end + 1):
                        exact[k] = end + 1
                    continue
                a = max(end + 1 - n - at - item.errors, 0)
                b = end + 1 - n - at + len(item.text) + item.errors
                had = windows.setdefault(k, [])
                if had and a <= had[-1][1]:
                    had[-1][0] = min(had[-1][0], a)
                    had[-1][1] = max(had[-1][1], b)
                else:
                    had.append([a, b])
        out = [(self.items[k].item_id, 0, 0, end) for k, end in exact.items()]
        for k, had in windows.items():
            i, t, e = self.items[k][:3]
            best, end = e + 1, -1
            for a, b in had:
                d, j = myers(t, text[a:b], e)
                if d < best:
                    best, end = d, a + j
                if not best:
                    break
            if best <= e:
                out.append((i, best, e, end))
        return out


def _blocks(benchmark: DataFrame, error_rate: float, min_chars: int, block_chars: int) -> Iterator[list[Item]]:
    """Items in blocks of about ``block_chars`` characters (an item longer than that is a block of its own)."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // max(1, block_chars // 2)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text", block.alias("block"))
    for b in range(n):
        items = [i for r in rows.where(F.col("block") == b).orderBy("item_id", "text").toLocalIterator()
                 if (i := prepare(r["item_id"], r["text"], error_rate, min_chars))]
        if items:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, allowed, end) of every item found in a document."""
    schema = "doc_id bigint, item_id bigint, distance bigint, allowed bigint, end bigint"
    texts = docs.select("doc_id", "text")

    def search(items):
        def run(batches):
            finder = Finder(items)
            for batch in batches:
                found = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in finder.find(t)]
                cols = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "item_id", "distance", "allowed", "end"), cols)})
        return map_batches(texts, run, schema)

    parts = [search(items) for items in _blocks(benchmark, error_rate, min_chars, block_chars)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows in which a benchmark item stands; every column passes through."""
    at = docs.columns.index("text")

    def clean(items):
        def run(batches):
            finder = Finder(items)
            for batch in batches:
                fine = [not (t and finder.find(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(fine, pa.bool_()))
        return run

    for items in _blocks(benchmark, error_rate, min_chars, block_chars):
        docs = map_batches(docs, clean(items), docs.schema)
    return docs
