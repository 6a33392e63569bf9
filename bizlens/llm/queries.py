"""Registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read

#: name -> (query, DuckDB SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def keep(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn
    return keep


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine (installed on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of at most 2048 tokens."""
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte", end_id=0, limit=2048)


@_query()
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found, within its edit budget, in any document."""
    from .decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query()
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched frame-of-reference token files over all documents, read back."""
    from .token_output import token_table

    return token_table(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "word", end_id=1)


@_query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the labels of the held-out fold are never read by the fit."""
    from .toxicity import toxic_scores

    return toxic_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op10_sql() -> str:
    from .line_dedup import sql

    return f"SELECT doc_id, n_lines, n_removed, whole_copy, md5(text) AS text_md5 FROM ({sql()})"


@_query(_op10_sql())
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites, with a digest of what is left."""
    from pyspark.sql import functions as F

    from .line_dedup import remove_boilerplate

    return remove_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "whole_copy", F.md5("text").alias("text_md5"))


def _op3_sql() -> str:
    from .quality import sql

    return sql()


@_query(_op3_sql())
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict of its host."""
    from .quality import judge

    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op8_sql() -> str:
    from .near_dup import SQL

    return SQL


@_query(_op8_sql())
def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from .near_dup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@_query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract

    return extract(read(spark, sf_dir, "pages"))


@_query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; the values leave as digests."""
    from pyspark.sql import functions as F

    from .secrets import scan

    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "place", "offset", "length", F.md5("value").alias("value_md5"), F.round("score", 6).alias("score"), "is_secret")


#: DuckDB twin of op5: every window by its word list.
OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM d WHERE len(ws) >= 20),
g AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS g FROM w),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, range(0, 20) t(o)),
x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda y, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""


@_query(OP5_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that stand earlier too, as digests."""
    from pyspark.sql import functions as F

    from .substring_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _op11_sql() -> str:
    from .manifest import sql

    return sql()


@_query(_op11_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, and every document of a tampered delivery checked against it."""
    from .manifest import verify

    return verify(read(spark, sf_dir, "documents")).drop("lang", "position")


def _op12_sql() -> str:
    from .reversed_search import SQL

    return SQL


@_query(_op12_sql())
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from .reversed_search import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


@_query()
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, uniformly shuffled."""
    from .sharding import digest

    return digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
