"""SuperMinHash near-duplicate detection with exact confirmation.

1. *Sets*: distinct 5-word shingles (64-bit hashes) of every whole text, ASCII
   letters lowered.  Documents of equal sets are one class from here on.
2. *SuperMinHash*: per shingle a random permutation of the signature places,
   drawn place by place; a place keeps the least ``round + uniform``.  All
   shingles of a document advance together and the document stops once every
   place is below the next round.  Signatures are cut into bands.
3. *Star rounds*: every bucket of a band names a pivot; members outside the
   pivot's group are confirmed against it on full sets.  Copies of a text meet
   their pivot in one round, so a group of any size costs a pair per member.
4. *Blocks*: buckets that still hold several groups are compared exactly: the
   members outside the largest group against all members of their cluster, in
   blocks of bounded size, so no link among bucket mates is lost and no task
   holds a whole cluster.  Only links that join groups are emitted.
5. *Union-find* as joins: least label with pointer jumping over the links.

Links, groups and sets stay distributed; the driver sees row counts and two key
filters of bounded size only, which keep texts that a join cannot match out of
its shuffle.  The tasks of a round over links follow their number, not the session's shuffle
partitions, and what a round has written goes once the next one has read it.

Edge cases: null, empty and blank texts have an empty set and link with
nothing; a text of 1 to 4 words is one shingle; repeated rows are copies;
rows with a null doc_id never name a component (its id is the least non-null
one, or null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.paging import global_index

from .common import discard, in_filter, key_filter, key_hash, map_batches, slices, stored

WORDS = 5
SIMILARITY_PCT = 75
BANDS, ROWS = 32, 4
#: Characters handled at a time in a worker.
SLICE_CHARS = 600_000
#: Bounds of a block of step 4: classes and shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 150_000
#: Links of a task: rounds over a few links take a few tasks.
LINK_ROWS = 100_000
#: Star rounds go on while at least this share of the confirmed pairs are links.
STAR_YIELD, MAX_STAR_ROUNDS = 0.1, 3

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, set size per text)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    own = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: ASCII letters and white space only
    counts = np.fromiter(map(len, own), np.int64, len(own))
    h = np.fromiter((digest(w) for ws in own for w in ws), np.uint64, int(counts.sum()))
    first = np.cumsum(counts) - counts
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(own)), n)
    at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    width = np.minimum(counts, words)[doc]
    s = np.zeros(len(doc), np.uint64)
    for k in range(words):
        live = k < width
        s = np.where(live, _mix(s * np.uint64(31) + h[np.minimum(at + k, max(len(h) - 1, 0))] + _G), s) if len(h) else s
    s = _mix(s + width.astype(np.uint64))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], np.bincount(doc[keep], minlength=len(own)).astype(np.int64)


def superminhash(sets: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m); documents without elements keep infinity."""
    sig = np.full(len(sizes) * m, np.inf)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    state = sets.copy()
    perm = None
    for j in range(m):
        if not len(doc):
            break
        state = state + _G
        z = _mix(state)
        k = j + ((_mix(z ^ _G) >> np.uint64(33)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            place = k
        else:
            row = np.arange(len(doc))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(sig, doc * m + place, j + (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
        live = (sig.reshape(-1, m).max(axis=1) >= j + 1)[doc]
        if perm is None:
            doc, state, k = doc[live], state[live], k[live]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(doc), 1))
            perm[np.arange(len(doc)), k] = 0
        elif not live.all():
            doc, state, perm = doc[live], state[live], perm[live]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of every band (documents x bands); the band's number is part of it."""
    x = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, x.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(31) + x[:, :, r])
    return key


def _class(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, cls, bands): set size, 128-bit set class and band keys of every row."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts, lambda t: len(t or ""), SLICE_CHARS):
                s, n = shingle_sets(texts[lo:hi], words)
                keys = band_keys(superminhash(s, n, bands * rows), bands, rows).view(np.int64)
                parts = np.split(s, np.cumsum(n)[:-1]) if len(n) else []
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(lo, hi - lo).cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()),
                    "cls": pa.array([_class(p) if len(p) else None for p in parts], pa.binary()),
                    "bands": pa.array([list(k) if c else None for k, c in zip(keys, n)], pa.list_(pa.int64()))})

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>")


def class_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, n, set) of the wanted classes; ``wanted``: (doc_id, cls), a document of each class.

    The sets are made where the texts are, of the rows that the filter holds for wanted ones.
    """
    test = key_filter(wanted, "doc_id")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).filter(pa.array(test(batch.column(0).to_numpy()))).to_pylist()
            for lo, hi in slices(texts, lambda t: len(t or ""), SLICE_CHARS):
                s, n = shingle_sets(texts[lo:hi], words)
                parts = [p for p in np.split(s, np.cumsum(n)[:-1]) if len(p)]
                yield pa.RecordBatch.from_pydict({
                    "cls": pa.array([_class(p) for p in parts], pa.binary()), "n": pa.array([len(p) for p in parts], pa.int64()),
                    "set": pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))})

    made = map_batches(docs.select(key_hash(F.col("doc_id")), "text"), run, "cls binary, n bigint, set array<bigint>")
    return made.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _tasks(rows: int) -> int:
    """Tasks for so many links or nodes."""
    return max(1, -(-rows // LINK_ROWS))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: least label, spread over the links with pointer jumping."""
    tasks = _tasks(2 * links.count())
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct().coalesce(tasks), "links")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).coalesce(tasks), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root", F.lit(None).cast(label.schema["root"].dataType).alias("old"))
        step = label.select("node", "root", F.col("root").alias("old")).unionAll(near).coalesce(tasks).groupBy("node").agg(F.min("root").alias("next"), F.max("old").alias("old")).coalesce(tasks)
        up = label.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = stored(step.join(up, F.col("next") == F.col("n2"), "left").select(
            "node", F.least("next", F.coalesce("r2", "next")).alias("root"), "old").coalesce(tasks), "labels")
        changed = new.where("root <> old").limit(1).count()
        discard(label)
        label = new.select("node", "root")
        if not changed:
            discard(both)
            return label


def _is_link(inter, na, nb, pct: int):
    return 100 * inter >= pct * (na + nb - inter)


def _confirm(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, flagged."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    fit = (100 * F.col("na") >= pct * F.col("nb")) & (100 * F.col("nb") >= pct * F.col("na"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.coalesce(fit & _is_link(inter, F.col("na"), F.col("nb"), pct), F.lit(False)).alias("linked"))


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("cls"))
    return members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _pivots(labelled: DataFrame, turn: int) -> DataFrame:
    """(key, pivot, pivot_root) of every bucket with several groups: a member of its largest group, another each turn."""
    per = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("o"), "cls")).alias("p"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "root", "p")).alias("t"), F.count("*").alias("groups"))
    return top.where("groups > 1").select("key", F.col("t.p.cls").alias("pivot"), F.col("t.root").alias("pivot_root"))


def _block_links(pct: int):
    """Links between the groups of a block pair: exact intersections by products of incidence matrices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cls"]).drop_duplicates("cls").reset_index(drop=True)
        n = pdf["n"].to_numpy(np.int64)
        flat = np.concatenate(pdf["set"].to_numpy()) if len(pdf) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(pdf)), n)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        col = np.cumsum(new) - 1
        shared = np.bincount(col, minlength=1)[col] > 1 if len(col) else np.zeros(0, bool)
        doc, col = doc[shared], col[shared]
        col = np.unique(col, return_inverse=True)[1]
        inter = np.zeros((len(pdf), len(pdf)), np.float32)
        bounds = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + 4096, 4096))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                x = np.zeros((len(pdf), 4096), np.float32)
                x[doc[a:b], col[a:b] - 4096 * i] = 1
                inter += x @ x.T
        inter = inter.astype(np.int64)
        hit = np.argwhere(np.triu(_is_link(inter, n[:, None], n[None, :], pct), 1))
        group = pdf["root"].tolist()
        parent = {g: g for g in group}

        def find(g):
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        cls, out = pdf["cls"].tolist(), []
        for i, j in hit:
            a, b = find(group[i]), find(group[j])
            if a != b:
                parent[a] = b
                out.append((cls[i], cls[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _blocks(members: DataFrame, sets: DataFrame, roots: DataFrame | None, pct: int) -> DataFrame:
    """Links missed by the star rounds, from the buckets that still hold several groups (stored)."""
    labelled = _labelled(members, roots)
    open_keys = _pivots(labelled, 0)
    rows = stored(members.join(open_keys, "key").select("cls", "pivot").distinct(), "open")
    clusters = components(rows.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
    tasks = _tasks(clusters.count())
    grouped = stored(_labelled(clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster")), roots).coalesce(tasks), "grouped")
    per = grouped.groupBy("cluster", "root").count().coalesce(tasks).groupBy("cluster").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    part = grouped.join(per, "cluster").coalesce(tasks).join(sets.select("cls", "n"), "cls").withColumn("outer", F.col("root") != F.col("main"))
    part = stored(part.coalesce(tasks), "part")
    sizes = part.groupBy("cluster").agg(*[
        F.greatest(F.ceil(F.count(F.when(c, 1)) / BLOCK_CLASSES), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias(k)
        for k, c in (("outers", F.col("outer")), ("mains", ~F.col("outer")))])
    part = part.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("outer"), F.col("outers")).otherwise(F.greatest("mains", F.lit(1)))).cast("int"))
    # an outer block meets every outer block once and every main block; a main block meets every outer block
    outers = F.sequence(F.lit(0), F.col("outers") - 1)
    mains = F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), F.lit(k).alias("k"))
    own = F.concat(F.transform(outers, lambda o: pair(F.least(o, "block"), F.greatest(o, "block"), 0)), F.transform(mains, lambda o: pair(F.col("block"), o, 1)))
    other = F.transform(outers, lambda o: pair(o, F.col("block"), 1))
    dealt = part.select("cls", "root", "cluster", F.col("outer").alias("side"), F.explode(F.when(F.col("outer"), own).otherwise(other)).alias("p"))
    found = stored(dealt.join(sets, "cls").select("cls", "root", "side", "cluster", "p.i", "p.j", "p.k", "n", "set")
                   .groupBy("cluster", "i", "j", "k").applyInPandas(lambda pdf: _block_links(pct)(pdf), "a binary, b binary"), "blocks")
    for used in (rows, clusters, grouped, part):
        discard(used)
    return found


def _joined(links: DataFrame | None, more: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All links with ``more`` of them, and their components in place of ``roots``."""
    links = more if links is None else links.unionAll(more)
    new = components(links)
    if roots is not None:
        discard(roots)
    return links, new


def near_duplicates(docs: DataFrame, words: int = WORDS, pct: int = SIMILARITY_PCT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sig = stored(signatures(docs, words, bands, rows), "signatures")
    classes = sig.where("cls IS NOT NULL").select("cls", "bands").dropDuplicates(["cls"])
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    members = stored(keyed.join(shared, "key").select("key", "cls"), "members")
    reps = stored(members.select("cls").distinct().join(sig.where("doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "cls"), "reps")
    sets = stored(class_sets(docs, reps, words), "sets")
    discard(reps)
    links, roots, written = None, None, [members, sets]
    for turn in range(MAX_STAR_ROUNDS):
        labelled = _labelled(members, roots)
        pivots = _pivots(labelled, turn)
        # each member of another group meets the least and the greatest of its buckets' pivots, by two orders
        met = labelled.join(pivots, "key").where("root <> pivot_root").groupBy("cls").agg(
            F.min("pivot").alias("p"), F.max("pivot").alias("q"),
            F.min(F.struct(F.xxhash64("pivot"), "pivot"))["pivot"].alias("r"), F.max(F.struct(F.xxhash64("pivot"), "pivot"))["pivot"].alias("s"))
        pairs = met.select(F.col("cls").alias("a"), F.explode(F.array_distinct(F.array("p", "q", "r", "s"))).alias("b"))
        flagged = stored(_confirm(pairs, sets, pct), "star")
        written.append(flagged)
        count = flagged.agg(F.count("*").alias("n"), F.count(F.when(F.col("linked"), 1)).alias("k")).first()
        if not count["n"]:
            break
        if count["k"]:
            links, roots = _joined(links, flagged.where("linked").select("a", "b"), roots)
        if count["k"] < STAR_YIELD * count["n"]:
            break
    if not (links is None and not count["n"]):
        more = _blocks(members, sets, roots, pct)
        written.append(more)
        if more.limit(1).count():
            links, roots = _joined(links, more, roots)
    for used in written:
        discard(used)
    base = sig.select("doc_id", "n_shingles", "cls")
    if roots is None:
        base = base.withColumn("root", F.col("cls"))
    else:
        base = base.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = base.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = base.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _groups(docs: DataFrame, **options) -> DataFrame:
    """``near_duplicates``, written once; what it was made from goes."""
    found = near_duplicates(docs, **options)
    groups = stored(found, "groups")
    discard(found)
    return groups


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone``; only rows that the filter holds for one of them are joined."""
    holds = in_filter(key_filter(gone, "doc_id"), F.col("doc_id"))
    left = docs.where(holds).join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~holds).unionAll(left)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: the one with the least id, a null id last; rows without words are in no group and stay.

    Rows are told apart by themselves, not by their ids: where ids repeat or are
    null, the rows are numbered in their order first.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("some")).first()
    repeated = ids["some"] < ids["n"] or docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        groups = _groups(docs, **options)
        return _without(docs, groups.where("NOT kept").select("doc_id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("own"), F.md5("text").alias("mark"), whole)
    rows = stored(global_index(rows, ["last", "own", "mark"], "doc_id").select("doc_id", "doc"), "rows")
    groups = _groups(rows.select("doc_id", "doc.text"), **options)
    kept = _without(rows, groups.where("NOT kept").select("doc_id"))
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: DuckDB twin of ``near_duplicates`` by counting shared shingles.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.root AS component_id, c.root = n.doc_id AS kept
FROM n JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = n.doc_id
"""
