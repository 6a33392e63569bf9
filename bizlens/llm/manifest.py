"""Merkle manifest of a dataset, with leaf places from bitmap ranks instead of a sort.

A row is a leaf.  The leaves of a group (a lang) ascend by key (doc_id); while a
group has several nodes, every ``ARITY`` consecutive ones become the digest of
their digests.  What remains is the group's subroot, and the subroots, in order
of the group, give the root in the same way.

1. *Bitmaps*: the keys of a group are 64-bit words, merged by ``bit_or`` (map-side
   partial words, so repeated keys shrink before the shuffle); only words that
   hold a key exist, so sparse keys cost a word each.
2. *Popcount directories*: word counts are summed up a tree of fan-out 4096 over
   the key space and handed down as "rows before"; no group of it is larger.
3. *Rank*: a leaf's place is the rows before its word plus the set bits below
   its own.  No rows are sorted.  Only rows of repeated or null keys are
   numbered among themselves, by range partitioning, so a hot key is split.
4. *Slot arrays*: the place names a block of ``ARITY ** 3`` leaves and the slot in
   it; a block is reduced in one task, and its root is a leaf of the next pass.
5. *Proofs*: from the root down, a block hands every child the siblings of each
   level above it.

Edge cases: null keys come first in their group; rows of one key are ordered by
leaf digest (equal digests are interchangeable); a null group is a group of
its own and comes before all others; an empty table gives an empty result; a
single leaf is subroot and root; extra columns pass through, but for those
named like an added one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.operators.paging import global_index

from .common import stored

ARITY = 8
#: Levels that a block reduces, and so its slots.
DEPTH = 3
BLOCK = ARITY ** DEPTH
#: Bits of a key below each level of the directory: words, then nodes of 4096 children.
SHIFTS = (6, 18, 30, 42, 54)
ADDED = ("position", "subroot", "root", "proof")
PROOF = "array<struct<before:string,after:string>>"


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the columns: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


# --- places ---------------------------------------------------------------
def _before(words: DataFrame) -> DataFrame:
    """(g, word, before): rows of the group in words below each word.  ``words``: (g, node, n), unique."""
    levels = [words]
    for low, high in zip(SHIFTS, SHIFTS[1:]):
        levels.append(stored(levels[-1].groupBy("g", F.shiftright("node", high - low).alias("node")).agg(F.sum("n").alias("n")), "manifest-level"))
    down = levels[-1].select("g").distinct().select("g", F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("base"))
    for i in range(len(SHIFTS) - 1, -1, -1):
        # the children of a node, at most 4096 of them (1024 at the top, the sign's two halves together)
        parent = F.shiftright("node", SHIFTS[i + 1] - SHIFTS[i]) if i + 1 < len(SHIFTS) else F.lit(0).cast("bigint")
        below = F.sum("n").over(Window.partitionBy("g", "parent").orderBy("node")) - F.col("n")
        nodes = levels[i].select("g", parent.alias("parent"), "node", "n").withColumn("below", below)
        down = nodes.join(down, ["g", "parent"]).select("g", F.col("node").alias("parent"), (F.col("base") + F.col("below")).alias("base"))
    return down.withColumnsRenamed({"parent": "word", "base": "before"})


def places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, key, leaf, ...; written) with ``position`` in the group."""
    word, bit = F.shiftright("key", 6), F.col("key").bitwiseAND(F.lit(63)).cast("int")
    keyed = leaves.where("key IS NOT NULL").select("g", "key", word.alias("node"))
    words = stored(keyed.groupBy("g", "node").agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits"), F.count(F.lit(1)).alias("n")), "manifest-words")
    # words with more rows than bits hold repeated keys: their bits and rows beyond the first
    more = words.where(F.bit_count("bits") < F.col("n")).select("g", "node")
    extra = (keyed.join(more, ["g", "node"], "left_semi").groupBy("g", "node", "key").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
             .groupBy("g", "node").agg(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("bit"), "extra")).alias("extras")))  # at most 64
    before = _before(words.select("g", "node", "n"))
    nulls = leaves.where("key IS NULL").groupBy("g").agg(F.count(F.lit(1)).alias("nulls"))
    directory = (words.select("g", F.col("node").alias("word"), "bits").join(before, ["g", "word"])
                 .join(extra.withColumnRenamed("node", "word"), ["g", "word"], "left").join(nulls, "g", "left")
                 .select("g", "word", "bits", (F.col("before") + F.coalesce("nulls", F.lit(0))).alias("before"), F.coalesce("extras", F.array().cast("array<struct<bit:int,extra:bigint>>")).alias("extras")))
    ranked = leaves.withColumn("word", word).join(directory, ["g", "word"], "left").withColumn("bit", bit)
    mask = F.expr("~ shiftleft(-1L, bit)")  # the bits below the own one
    rank = (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(mask))
            + F.aggregate(F.filter("extras", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("bigint"), lambda a, x: a + x["extra"]))
    tied = F.col("key").isNull() | F.exists("extras", lambda x: x["bit"] == F.col("bit"))
    ranked = stored(ranked.select(*[F.col(c) for c in leaves.columns], F.coalesce(rank, F.lit(0).cast("bigint")).alias("position"), tied.alias("tied")), "manifest-ranked")
    rows = [*leaves.columns, "position"]
    alone, ties = ranked.where(~F.col("tied")).select(*rows), ranked.where("tied").select(*rows)
    if ties.isEmpty():
        return alone
    numbered = stored(global_index(ties, ["g", "position", "leaf"], "i"), "manifest-ties")
    first = numbered.groupBy("g", "position").agg(F.min("i").alias("first"))
    numbered = numbered.join(first, ["g", "position"]).withColumn("position", F.col("position") + F.col("i") - F.col("first"))
    return alone.unionByName(numbered.select(*rows))


# --- the tree -------------------------------------------------------------
def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """The digests of a block level by level; ``n`` nodes stand in the whole group."""
    levels = [digests]
    while n > 1 and len(levels) <= DEPTH:
        levels.append([_hash(levels[-1][i:i + ARITY]) for i in range(0, len(levels[-1]), ARITY)])
        n = -(-n // ARITY)
    return levels


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _slots(table: pa.Table) -> list[str]:
    """The block's digests in an array keyed by slot."""
    array = [""] * table.num_rows
    for p, d in zip(_column(table, "position"), _column(table, "leaf")):
        array[p % BLOCK] = d
    return array


def _reduce(table: pa.Table) -> pa.Table:
    n = table.column("n")[0].as_py()
    root = _levels(_slots(table), n)[-1][0]
    return pa.table({"g": table.column("g").slice(0, 1), "position": pa.array([table.column("position")[0].as_py() // BLOCK], pa.int64()),
                     "n": pa.array([-(-n // BLOCK)], pa.int64()), "leaf": pa.array([root], pa.string())})


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block, each with its proof and the block's columns (g, proof, subroot, root)."""
    if not nodes.num_rows:
        return pa.table({})
    levels = _levels(_slots(nodes), nodes.column("n")[0].as_py())
    top = _column(above, "proof")[0]
    proofs = []
    for p in _column(nodes, "position"):
        at, own = p % BLOCK, []
        for level in levels[:-1]:
            lo, k = at // ARITY * ARITY, at % ARITY
            own.append({"before": "".join(level[lo:lo + k]), "after": "".join(level[lo + k + 1:lo + ARITY])})
            at //= ARITY
        proofs.append(own + top)
    out = nodes.append_column("proof", pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([above.column(name)[0].as_py()] * nodes.num_rows, pa.string()))
    return out


def _block() -> Column:
    return F.expr(f"position div {BLOCK}").alias("block")


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Passes of nodes (g, position, n, leaf), the last with one node a group of at most ``most``."""
    passes = [nodes]
    while most > 1:
        up = passes[-1].select("g", "position", "n", "leaf", _block()).groupBy("g", "block").applyInArrow(_reduce, "g string, position bigint, n bigint, leaf string")
        passes.append(stored(up, "manifest-nodes"))
        most = -(-most // BLOCK)
    return passes


def _proofs(passes: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the first pass with proof, subroot and root; ``top`` (g, proof, subroot, root) is of the last pass's nodes."""
    above = passes[-1].drop("n", "leaf").join(top, "g").withColumnRenamed("position", "block").select("g", "block", "proof", "subroot", "root")
    for nodes in reversed(passes[:-1]):
        held = nodes.withColumn("block", _block())
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + f", proof {PROOF}, subroot string, root string"
        below = held.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_descend, schema).drop("block")
        if nodes is passes[0]:
            return below
        above = stored(below.select("g", F.col("position").alias("block"), "proof", "subroot", "root"), "manifest-proofs")
    return passes[0].join(above.drop("block"), "g")


def prove(leaves: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf") -> DataFrame:
    """``leaves`` with ``position`` in the group, ``subroot``, ``root`` and ``proof``.

    ``key``: integer column; ``group``: text column; ``leaf``: hex digests.  A
    proof has an entry for every level below the root: the digests, joined, that
    stand before and after the own one in its run.
    """
    g = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`")))  # null first, then bytewise
    whole = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("doc")
    rows = stored(leaves.select(g.alias("g"), F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{leaf}`").alias("leaf"), whole), "manifest-leaves")
    sizes = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "manifest-groups")
    n_groups, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = stored(places(rows).join(sizes, "g").select("g", "position", "n", "leaf", "doc"), "manifest-placed")
    passes = _climb(nodes, most)
    # the groups are the leaves of the top tree, all in one group
    order = global_index(sizes.select(F.col("g").alias("name")), "name", "position")
    tops = stored(passes[-1].select(F.col("g").alias("name"), F.col("leaf")).join(order, "name")
                  .select(F.lit("").alias("g"), "position", F.lit(n_groups).cast("bigint").alias("n"), "leaf", "name"), "manifest-tops")
    upper = _climb(tops, n_groups)
    crown = upper[-1].select("g", F.array().cast(PROOF).alias("proof"), F.lit("").alias("subroot"), F.col("leaf").alias("root"))
    top = _proofs(upper, crown).select(F.col("name").alias("g"), "proof", F.col("leaf").alias("subroot"), "root")
    proved = _proofs(passes, stored(top, "manifest-top"))
    return proved.select(*[F.col(f"doc.`{c}`").alias(c) for c in leaves.columns if c not in ADDED], *ADDED)


# --- the check of a delivery ----------------------------------------------
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text() -> Column:
    """The text of a delivery in which every third document or so, by a checksum of its id, lost its capitals."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def verify(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and the check of a tampered delivery against it, a row a document."""
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    leaves = docs.select("doc_id", "lang", leaf_digest(*fields(F.col("text"))).alias("leaf"), leaf_digest(*fields(tampered_text())).alias("delivered"))
    proved = prove(leaves).withColumn("folded_root", fold(F.col("delivered"), F.col("proof")))
    return proved.select("doc_id", "lang", "position", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC32 = """(list_reduce(flatten(list_transform(range(1, length({x}) + 1), lambda i: [CAST(unicode(substr({x}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295))"""


def sql(levels: int = 7) -> str:
    """DuckDB twin of ``verify`` for groups (and numbers of groups) of at most ``ARITY ** levels`` rows."""
    def digest(text: str) -> str:
        cols = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols) + ")"

    def climb(name: str, base: str, part: str) -> list[str]:
        """Tables name0.. of nodes (part, pos, d) and name_run0.. of their runs' joined digests."""
        out = [f"{name}0 AS ({base})"]
        for k in range(levels):
            out.append(f"{name}_run{k} AS (SELECT {part}, pos // {ARITY} AS run, string_agg(d, '' ORDER BY pos) AS ds, (SELECT count(*) FROM {name}{k} AS o WHERE o.{part} IS NOT DISTINCT FROM n.{part}) AS n "
                       f"FROM {name}{k} AS n GROUP BY {part}, pos // {ARITY})")
            out.append(f"{name}{k + 1} AS (SELECT {part}, run AS pos, CASE WHEN n = 1 THEN ds ELSE sha256(ds) END AS d FROM {name}_run{k})")
        return out

    def path(name: str, source: str, out: str, part: str, pos: str) -> list[str]:
        """Tables that carry each document's siblings (sib) and folded digest (f) up the levels."""
        made, last = [], source
        for k in range(levels):
            slot = f"(({pos}) // {ARITY ** k}) % {ARITY}"
            lo, hi = f"substr(r.ds, 1, CAST(64 * ({slot}) AS BIGINT))", f"substr(r.ds, CAST(64 * ({slot}) + 65 AS BIGINT))"
            made.append(f"{out}{k} AS (SELECT p.* REPLACE (CASE WHEN r.n = 1 THEN sib ELSE sib || {lo} || {hi} END AS sib, CASE WHEN r.n = 1 THEN f ELSE sha256({lo} || f || {hi}) END AS f) "
                        f"FROM {last} AS p JOIN {name}_run{k} AS r ON r.{part} IS NOT DISTINCT FROM p.{part} AND r.run = ({pos}) // {ARITY ** (k + 1)})")
            last = f"{out}{k}"
        return made

    lowered = f"CASE WHEN xor({_CRC32.format(x='CAST(doc_id AS VARCHAR)')}, 4294967295) % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    tables = [f"raw AS (SELECT doc_id, lang, {digest('text')} AS leaf, {digest('(' + lowered + ')')} AS delivered FROM documents)",
              "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw)",
              *climb("t", "SELECT lang, pos, leaf AS d FROM leaves", "lang"),
              f"tops AS (SELECT lang, d AS subroot, 1 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_pos FROM t{levels} WHERE pos = 0)",
              *climb("u", "SELECT one, top_pos AS pos, subroot AS d FROM tops", "one"),
              "docs AS (SELECT l.*, s.subroot, s.one, s.top_pos, '' AS sib, delivered AS f FROM leaves AS l JOIN tops AS s ON s.lang IS NOT DISTINCT FROM l.lang)",
              *path("t", "docs", "a", "lang", "pos"), *path("u", f"a{levels - 1}", "b", "one", "top_pos")]
    return ("WITH " + ",\n".join(t if " AS (" not in t[:40] else t.replace(" AS (", " AS MATERIALIZED (", 1) for t in tables)
            + f"\nSELECT doc_id, leaf, subroot, u.d AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = u.d AS verified FROM b{levels - 1}, u{levels} AS u")
