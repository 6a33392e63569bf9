"""Merkle manifest, reversed search and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.llm import manifest, reversed_search, sharding
from bizlens.llm.queries import queries
from llm_cases import edge_rows, edges, make_docs, no_docs, vocabulary_words  # noqa: F401

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, position string, root int, shard string, slot int, leaf int, g string, n int"


def docs_of(spark, rows):
    """(doc_id, text, lang) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, None if k % 4 == 0 else "s", None if k % 5 == 0 else k, "p", 1, "x", 2, 3, "y", 4) for k, (i, t, g) in enumerate(rows)], DOCS)


# --- op11 -----------------------------------------------------------------
def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    def leaf(r, text):
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))

    groups = defaultdict(list)
    for r in rows:
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, text), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top, out = tree([trees[g][-1][0] for g in order]), []
    for gi, g in enumerate(order):
        for i, (_, _, own, delivered, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            siblings, folded = [], delivered
            for levels, at in ((trees[g], i), (top, gi)):
                for level in levels[:-1]:
                    run, k = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
                    siblings += run[:k] + run[k + 1:]
                    folded = sha(run[:k] + [folded] + run[k + 1:])
                    at //= 8
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], sha(siblings), folded, folded == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(n, langs, key, seed=3):
    rnd = random.Random(seed)
    return [(key(rnd, k), rnd.choice(["Some Text", None, "", "É Z ß", "w " * 5000]), rnd.choice(langs)) for k in range(n)]


@pytest.mark.parametrize("n, langs, key", [
    (0, ["en"], lambda r, k: k), (1, ["en"], lambda r, k: k), (9, [None], lambda r, k: k),
    (1500, ["en", None, "", "fr", "é"], lambda r, k: r.choice([None, 7, 7, k, -k, r.randrange(-2 ** 63, 2 ** 63), 2 ** 63 - 1, -2 ** 63])),
    (600, [f"l{k}" for k in range(560)], lambda r, k: k), (4700, ["en"], lambda r, k: 7 * k)])
def test_manifest_matches_brute_force(spark, n, langs, key):
    docs = docs_of(spark, manifest_rows(n, langs, key))
    got = [tuple(r[c] for c in MANIFEST) for r in manifest.verify(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest([r.asDict() for r in docs.collect()]), key=str)


def test_manifest_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = [tuple(r[c] for c in MANIFEST) for r in queries()["op11_merkle_manifest"](spark, SMALL).collect()]
    want = brute_manifest([r.asDict() for r in docs.collect()])
    assert sorted(got) == sorted(want) and any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_proofs_are_whole(spark):
    leaves = docs_of(spark, manifest_rows(700, ["a", "b"], lambda r, k: k)).drop("leaf").withColumn("leaf", manifest.leaf_digest(F.col("doc_id"), F.col("text")))
    proved = manifest.prove(leaves)
    assert set(proved.columns) == set(leaves.columns) | set(manifest.ADDED)  # clashing columns are replaced, others kept
    for r in proved.collect():
        d = r["leaf"]
        for p in r["proof"]:
            d = sha([p["before"], d, p["after"]])
        assert d == r["root"]
    assert [r["position"] for r in proved.where("lang = 'a'").orderBy("doc_id").collect()] == list(range(proved.where("lang = 'a'").count()))


# --- op12 -----------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_terms if n_terms else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, q in Counter(terms_of(text)).items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_cases():
    rows = [(i, t) for i, t, _ in edge_rows()] + [(70 + k, "same copy of one text") for k in range(30)] + [(None, "same copy of one text")]
    rnd, words = random.Random(8), vocabulary_words()
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "same COPY, copy of"), (102, "same copy"), (None, "İΣ weird 😀 x_1"), (103, "nobodyhasthis"), (104, " ".join(rnd.choice(words) for _ in range(3000)))]
    return rows, items


@pytest.mark.parametrize("block_terms", [250_000, 40])
def test_search_matches_brute_force(spark, block_terms):
    rows, items = search_cases()
    docs = make_docs(spark, [(i, t, "s") for i, t in rows]).repartition(7)
    queries_ = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, score int, item int")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in reversed_search.search(docs, queries_, block_terms=block_terms).collect()]
    assert sorted(got, key=str) == brute_search(rows, items)


def test_search_blocks_are_bounded(spark):
    rows = [(item, t) for item, n in enumerate([3, 50, 7, 7, 7, 12, 1, 19, 20, 20, 5] * 4) for t in range(n)]
    terms = spark.createDataFrame([(i, i, str(t).encode(), 1) for i, t in rows], "item bigint, item_id bigint, term binary, times bigint")
    blocks = reversed_search.item_blocks(terms, 20).groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).collect()
    assert sum(b["n"] for b in blocks) == len(rows) and all(b["n"] <= 20 or b["items"] == 1 for b in blocks)
    assert reversed_search.item_blocks(terms, 20).groupBy("item").agg(F.countDistinct("block").alias("k")).where("k > 1").count() == 0


def test_search_of_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert reversed_search.search(no_docs, items).collect() == []
    assert reversed_search.search(make_docs(spark, [(1, "a", "s")]), items.limit(0)).collect() == []


def test_long_texts_are_counted_by_slices(monkeypatch):
    text = " ".join(f"W{k % 97}" for k in range(5000)).encode()
    want = reversed_search.term_counts(text)
    monkeypatch.setattr(reversed_search, "SLICE_BYTES", 61)
    assert reversed_search.term_counts(text) == want == Counter(t.encode() for t in terms_of(text.decode()))


# --- op13 -----------------------------------------------------------------
@pytest.mark.parametrize("good, bad, n", [(5, 3, 4), (7, 9, 16), (0, 5, 3), (100, 50, 70), (1000, 15000, 3200), (15000, 1000, 12800), (40, 10 ** 6, 500_000), (2 * 10 ** 9, 28 * 10 ** 9, 5 * 10 ** 8)])
def test_hypergeometric_draws(spark, good, bad, n):
    k = 20_000
    big = [F.lit(v).cast("bigint") for v in (good, bad, n)]
    x = spark.range(k).select(sharding.hypergeometric(*big, F.lit(f"{good}-{bad}"), F.col("id")).alias("x")).toPandas().x.to_numpy()
    total = good + bad
    mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
    assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)
    assert abs(x.mean() - mean) <= 4.5 * (var / k) ** 0.5 + 1e-9 and abs(x.var() - var) <= 0.06 * var + 1e-9
    if total < 10 ** 9:
        y = np.random.default_rng(4).hypergeometric(good, bad, n, 200_000)
        assert max(abs((x <= q).mean() - (y <= q).mean()) for q in np.unique(y)) < 0.016  # Kolmogorov-Smirnov, 0.1 %


def test_matrix_has_exact_margins(spark):
    rnd = random.Random(2)
    sizes = {b: rnd.randint(1, 5000) for b in [*range(70), 1 << 17, (3 << 17) + 1, 1 << 40]}
    blocks = spark.createDataFrame(list(sizes.items()), "block bigint, n bigint")
    got = {r["block"]: r["counts"] for r in sharding.communication_matrix(blocks, 7, 5).collect()}
    total = sum(sizes.values())
    assert {b: sum(c) for b, c in got.items()} == sizes and all(x >= 0 for c in got.values() for x in c)
    assert [sum(c[s] for c in got.values()) for s in range(7)] == [total // 7 + (s < total % 7) for s in range(7)]


@pytest.mark.parametrize("n_shards", [1, 5, 16])
def test_shards_hold_every_row_once(spark, n_shards, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 3)  # many blocks and bins
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 8)
    rows = [(None if k % 9 == 0 else k % 50, None if k % 7 == 0 else "copy" if k % 3 else f"t{k}", "en") for k in range(301)]
    docs = docs_of(spark, rows).repartition(5)
    out = sharding.shuffle_into_shards(docs, n_shards)
    got = out.collect()
    assert set(out.columns) == set(docs.columns)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == sorted(301 // n_shards + (s < 301 % n_shards) for s in range(n_shards))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)


def test_lines_of_the_matrix_are_hypergeometric(spark):
    """A block of 4 of 20 rows dealt to 4 shards of 5, over many seeds."""
    matrix = defaultdict(int)
    blocks = spark.createDataFrame([(0, 8), (1, 8), (2, 4)], "block bigint, n bigint")
    n, seeds = F.col("n"), 4000
    caps = F.array(*[F.lit(5).cast("bigint")] * 4)
    for r in blocks.join(spark.range(seeds).withColumnRenamed("id", "seed")).where("block = 2").select(sharding.deal(caps, n, 4, F.col("seed")).alias("x")).collect():
        for s, x in enumerate(r["x"]):
            matrix[s, x] += 1
    # a shard of 5 of 20 places gets x of a block's 4 rows: C(4, x) C(16, 5 - x) / C(20, 5)
    for s in range(4):
        for x in range(5):
            p = math.comb(4, x) * math.comb(16, 5 - x) / math.comb(20, 5)
            assert abs(matrix[s, x] - seeds * p) < 4.5 * (seeds * p * (1 - p)) ** 0.5 + 1


def test_places_do_not_depend_on_origins(spark, monkeypatch):
    """Tenths of the input against tenths of the slots, blocks against shards, and neighbours."""
    monkeypatch.setattr(sharding, "BLOCK_BITS", 9)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 512)
    n, got = 6000, {}
    for r in sharding.shuffle_into_shards(spark.range(0, n, 1, 3).withColumnRenamed("id", "doc_id"), 4).collect():
        got[r["doc_id"]] = (r["shard"], r["slot"])
    for cell, shape in ((lambda i: (i * 10 // n, got[i][1] * 10 // 1500), (10, 10)), (lambda i: (i // 500, got[i][0]), (12, 4))):
        counts = np.zeros(shape)
        for i in range(n):
            counts[cell(i)] += 1
        expected, free = n / counts.size, (shape[0] - 1) * (shape[1] - 1)
        assert abs(((counts - expected) ** 2 / expected).sum() - free) < 4.5 * (2 * free) ** 0.5
    together = sum(got[i][0] == got[i + 1][0] for i in range(n - 1))
    assert abs(together - (n - 1) / 4) < 4.5 * (n * 3 / 16) ** 0.5


def test_sharding_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries()["op13_sharding"](spark, SMALL).collect()
    assert len(got) == len(docs) and {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {
        i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s, n in sizes.items() for k in range(n)}


def test_sharding_of_empty_table_and_files(spark, tmp_path):
    empty = docs_of(spark, []).select("doc_id", "text")
    assert sharding.digest(empty).collect() == []
    path = sharding.write_shards(docs_of(spark, [(k, f"t{k}", "en") for k in range(40)]), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(path).collect()
    assert Counter(r["shard"] for r in back) == {0: 14, 1: 13, 2: 13} and len({r["doc_id"] for r in back}) == 40


def test_sharding_plan_is_native(spark):
    plan = queries()["op13_sharding"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
