"""Corpus pipeline: STAGES over ``documents``, each written as Parquet and read again.

toxicity -> line dedup -> near-duplicates -> benchmark decontamination -> packing.
The first four return the columns of ``documents``; the last returns the packed
pieces.  Toxicity is a trained model, so there is no SQL twin; the tests compare
``run`` with a plain Python version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import read, stored
from bizlens.llm.decontamination import decontaminate
from bizlens.llm.line_dedup import remove_boilerplate
from bizlens.llm.near_dup import drop_near_duplicates
from bizlens.llm.packing import pack_documents
from bizlens.llm.queries import vocabulary
from bizlens.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field predicts toxic go."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go; ``n_chars`` follows the text."""
    out = remove_boilerplate(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), "byte", end_id=0, limit=2048)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; a stage reads what its predecessor wrote."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
