"""Encoding, name embeddings and closure models on MLlib.

Training and scoring run on the cluster; only fitted parameters (category
lists, trees, vectors) and metric tables reach the driver.

Known differences from the reference's single-machine libraries, reported
rather than hidden:
* boosted trees are MLlib's GBT (first-order, unregularised splits), not the
  reference's XGBoost; numbers differ;
* the grid search drops ``min_samples_split`` (no MLlib parameter) and maps
  ``min_samples_leaf`` to ``minInstancesPerNode``;
* cross-validation folds come from a hash of the licence id and are assigned
  before oversampling, so copies of a row never straddle folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import seeded_hash
from ..session import ensure_checkpoint_dir
from . import metrics as mt
from .paging import global_index

RF_TREES, RF_DEPTH, RF_SEED = 100, 10, 42
GBT_ROUNDS, GBT_DEPTH, GBT_RATE = 100, 6, 0.1
W2V_DIM, W2V_WINDOW, W2V_MIN_COUNT, W2V_EPOCHS = 50, 5, 1, 30
#: Tasks of the embedding trainer.  MLlib averages the partitions' updates after every
#: iteration, so the count is part of the model: it follows the number of names (one per
#: ``W2V_ROWS``, ``W2V_PARTITIONS`` at least), the same on any cluster.
W2V_PARTITIONS, W2V_ROWS = 8, 250_000
#: Partitions of a training set: part of a forest's bagging, so fixed as well.
TRAIN_PARTITIONS = 8
#: Weighted rows a partition of a collapsed training set: its size, not the cluster, sets the count.
GROUP_ROWS = 100_000
GRID_DEPTH = (10, 20)
GRID_MIN_LEAF = (1, 2)
CV_FOLDS = 3


# ------------------------------------------------------------------ encoding --
def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_index") -> DataFrame:
    """Categorical -> ordinal (most frequent = 0, ties alphabetical;
    unseen/null -> one extra index).  The output is a plain int: MLlib's
    nominal metadata would make trees treat it as categorical and fail once
    the arity exceeds ``maxBins``."""
    outs = [f"{c}{suffix}" for c in cols]
    model = StringIndexer(inputCols=list(cols), outputCols=[f"_{o}" for o in outs],
                          handleInvalid="keep", stringOrderType="frequencyDesc").fit(df)
    enc = model.transform(df)
    return enc.select(*df.columns, *[F.col(f"_{o}").cast("int").alias(o) for o in outs])


def label_encode_joined(df: DataFrame, cols: Sequence[str], suffix: str = "_index") -> DataFrame:
    """E1 for columns of any number of categories: the same indexes as ``label_encode``, with no category list on the driver.

    The categories of a column are counted, ranked by range partitioning (most
    frequent first, ties by their text) and joined back; AQE broadcasts a short
    list and splits the hot categories of a long one.  Nulls get one extra index.
    """
    out = df
    for i, c in enumerate(cols):
        text = F.col(f"`{c}`").cast("string")
        counts = df.where(text.isNotNull()).groupBy(text.alias("category")).agg((-F.count(F.lit(1))).alias("minus"))
        ranks = global_index(counts, ["minus", "category"], "rank").select(F.col("category").alias(f"_c{i}"), F.col("rank").cast("int").alias(f"_r{i}"))
        n = ranks.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
        joined = out.join(ranks, text == F.col(f"_c{i}"), "left")
        out = joined.select(*[F.col(f"`{k}`") for k in out.columns], F.coalesce(f"_r{i}", n).alias(f"{c}{suffix}"))
    return out


def one_hot(df: DataFrame, index_cols: Sequence[str], suffix: str = "_vec") -> DataFrame:
    """Ordinal -> sparse one-hot vector (no category dropped)."""
    outs = [f"{c}{suffix}" for c in index_cols]
    model = OneHotEncoder(inputCols=list(index_cols), outputCols=outs, dropLast=False,
                          handleInvalid="keep").fit(df)
    return model.transform(df)


def assemble(df: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] | None = None,
             label: str = "closed", out: str = "features") -> DataFrame:
    """E5: feature vector from an inclusion list, or every column not excluded."""
    cols = list(include) if include is not None else [c for c in df.columns if c not in set(exclude) | {label}]
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


# ---------------------------------------------------------------- embeddings --
def name_tokens(col: str, tokens: str = "words"):
    """Token array for a cleaned name: its whitespace-separated words (after C8),
    or the whole name as one token."""
    joined = tx.join_script_boundary(F.col(col))
    if tokens == "whole":
        return F.array(joined)
    return F.split(tx.collapse_ws(joined), " ")


def train_name_embedding(names: DataFrame, col: str = "clean_name", dim: int = W2V_DIM,
                         window: int = W2V_WINDOW, min_count: int = W2V_MIN_COUNT,
                         iters: int = W2V_EPOCHS, tokens: str = "words", seed: int = 42,
                         partitions: int | None = None):
    """Skip-gram embedding of names (MLlib Word2Vec).

    With ``tokens="whole"`` (the reference's choice) a sentence is one token,
    so there are no context pairs and vectors keep their seeded start; use
    ``"words"`` for real training.  MLlib keeps vocabulary x dim on the driver:
    raise ``min_count`` when distinct names reach millions.
    """
    sentences = names.where(F.col(col).isNotNull()).select(name_tokens(col, tokens).alias("_tok"))
    partitions = partitions or max(W2V_PARTITIONS, -(-sentences.count() // W2V_ROWS))
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=iters, seed=seed,
                   inputCol="_tok", outputCol="_vec", numPartitions=partitions)
    return w2v.fit(sentences)


def export_embeddings(names: DataFrame, model, dim: int = W2V_DIM, strict_reference: bool = False,
                      tokens: str = "words") -> DataFrame:
    """E4 + J6: (unique_id, business_name, cleaned_business_name, embedding_array).

    With ``tokens="words"`` a name's vector is the mean of its words' vectors
    (zeros when none is known), computed on the executors by the model itself.
    With ``"whole"`` it is looked up by the whole name: the lookup key is the C8-joined name, as used in training (the reference looks
    up the raw cleaned name, so mixed-script names get zeros there;
    ``strict_reference=True`` reproduces that).  Missing names get ``dim``
    zeros.  One distributed join replaces the reference's paged driver loop.
    """
    if tokens == "words":
        known = names.withColumn("_tok", F.coalesce(name_tokens("clean_name", tokens), F.array().cast("array<string>")))
        return model.transform(known).select(
            "unique_id", F.col("bizname").alias("business_name"), F.col("clean_name").alias("cleaned_business_name"),
            vector_to_array("_vec", "float32").alias("embedding_array"))
    vectors = model.getVectors().select(F.col("word"), vector_to_array("vector", "float32").alias("vector"))
    key = F.col("clean_name") if strict_reference else tx.join_script_boundary(F.col("clean_name"))
    base = names.select("unique_id", F.col("bizname").alias("business_name"),
                        F.col("clean_name").alias("cleaned_business_name"), key.alias("_key"))
    from .joins import attach_embedding
    out = attach_embedding(base, vectors, "_key", dim=dim)
    return out.drop("_key")


# -------------------------------------------------------------------- models --
def training_input(df: DataFrame, keys: Sequence[str] = ("unique_id", "draw"), partitions: int = TRAIN_PARTITIONS) -> DataFrame:
    """Materialise a (bounded) training set before fitting.

    Tree learners make many passes over their input; a sample built by
    splits, quotas and oversampling has a long lineage, so it is written once
    to the reliable checkpoint folder (lineage cut, survives executor loss).
    Rows go to ``partitions`` partitions by their ``keys``, in that order, so a
    seeded fit sees the same partitions on any machine.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [k for k in keys if k in df.columns]
    return df.repartition(partitions, *by).sortWithinPartitions(*by).checkpoint(eager=True)


def collapsed(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """One row per combination of ``by`` with its number of rows in ``weight``, written once.

    Categorical features take few combinations however many rows there are, and
    a learner that honours weights gets the same sums from them.  Every row
    counts; where all combinations differ, the table has as many rows as before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias(weight)).checkpoint(eager=True)
    return training_input(groups, by, 1 + groups.count() // GROUP_ROWS)


def save_model(model, path: str) -> None:
    """Write a fitted model (E3, E11-E13) with Spark's own format."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """Read a model of class ``kind`` (for instance ``Word2VecModel``)."""
    return kind.load(path)


def fit_concurrently(tasks: dict, max_workers: int = 4) -> dict:
    """Run independent fits as concurrent Spark jobs (as CrossValidator's
    ``parallelism`` does): a boosted-tree fit is a long chain of small jobs,
    so several fits interleave on the cluster instead of leaving it idle."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        futures = {name: pool.submit(fn) for name, fn in tasks.items()}
        return {name: f.result() for name, f in futures.items()}


def fold_column(key: str, folds: int = CV_FOLDS, seed: int = 42) -> F.Column:
    return F.pmod(seeded_hash(key, f"fold{seed}"), F.lit(folds)).cast("int")


def fit_rf(train: DataFrame, features: str = "features", label: str = "closed", weight_col: str | None = None,
           trees: int = RF_TREES, depth: int = RF_DEPTH, seed: int = RF_SEED, min_leaf: int = 1):
    """Random forest classifier."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth,
                                seed=seed, minInstancesPerNode=min_leaf)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf.fit(train)


class BaggedForest:
    """Trees fitted one by one; like MLlib's forest, the mean of their class probabilities decides (ties: the lower class)."""

    def __init__(self, trees: list):
        self.trees = trees

    def transform(self, df: DataFrame) -> DataFrame:
        out, votes = df, [f"_tree{i}" for i in range(len(self.trees))]
        for tree, col in zip(self.trees, votes):
            out = tree.setProbabilityCol(col).setRawPredictionCol("").setPredictionCol("").transform(out)
        out = out.select(*df.columns, F.array(*[vector_to_array(c) for c in votes]).alias("_votes"))

        def mean(k: int):
            return F.aggregate("_votes", F.lit(0.0), lambda total, vote: total + F.get(vote, F.lit(k))) / len(votes)

        out = out.withColumn("_p", F.array(*[mean(k) for k in range(self.trees[0].numClasses)]))
        return out.select(*df.columns, array_to_vector("_p").alias("probability"),
                          (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction"))


def fit_rf_collapsed(groups: DataFrame, by: Sequence[str], features: str = "features", label: str = "closed", weight: str = "weight",
                     trees: int = RF_TREES, depth: int = RF_DEPTH, seed: int = RF_SEED) -> BaggedForest:
    """E11 on ``collapsed`` rows: the forest that bagging of the single rows gives.

    Each of ``n`` equal rows is drawn Poisson(1) times for a tree, so the group
    is drawn Poisson(n) times: these draws are the weights of the tree.  They
    depend on the group (``by``), the seed and the tree only.
    """
    @F.pandas_udf("array<bigint>")
    def draws(group: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, g & (2 ** 64 - 1)]).poisson(k, trees).tolist() for g, k in zip(group.tolist(), n.tolist())])

    rows = groups.withColumn("_draws", draws(F.xxhash64(*by), F.col(weight)))
    rows = training_input(rows, by, groups.rdd.getNumPartitions())

    def tree(i: int):
        rf = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="_w", numTrees=1, maxDepth=depth, seed=seed + i,
                                    bootstrap=False, featureSubsetStrategy="sqrt")
        return rf.fit(rows.withColumn("_w", F.get("_draws", F.lit(i)).cast("double")))

    fitted = fit_concurrently({i: (lambda i=i: tree(i)) for i in range(trees)})
    return BaggedForest([fitted[i] for i in range(trees)])


def fit_gbt(train: DataFrame, features: str = "features", label: str = "closed", weight_col: str | None = None,
            rounds: int = GBT_ROUNDS, depth: int = GBT_DEPTH, rate: float = GBT_RATE, seed: int = 42):
    """Gradient-boosted trees with logistic loss."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=depth,
                        stepSize=rate, seed=seed, lossType="logistic")
    if weight_col:
        gbt.setWeightCol(weight_col)
    return gbt.fit(train)


def grid_search(train: DataFrame, features: str = "features", label: str = "closed", key: str = "unique_id",
                depths: Sequence[int] = GRID_DEPTH, min_leaf: Sequence[int] = GRID_MIN_LEAF,
                folds: int = CV_FOLDS, trees: int = RF_TREES, seed: int = RF_SEED, parallelism: int = 4):
    """Cross-validated grid over depth x min-leaf, metric F1 of class 1.

    ``train`` must carry a ``fold`` column (see ``fold_column``) assigned
    before any oversampling.
    """
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed)
    grid = (ParamGridBuilder().addGrid(rf.maxDepth, list(depths))
            .addGrid(rf.minInstancesPerNode, list(min_leaf)).build())
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        foldCol="fold", parallelism=parallelism, seed=seed)
    return cv.fit(train)


def score(model, df: DataFrame, keep: Sequence[str] = ("unique_id", "closed"),
          features: str = "features") -> DataFrame:
    """Batch scoring -> kept columns + predicted class + P(closed)."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      F.get(vector_to_array("probability"), 1).alias("p_closed"))


def importance_table(model, cols: Sequence[str], spark, k: int = 20) -> DataFrame:
    """Top-k feature importances of a fitted tree ensemble."""
    return mt.feature_importance(model.featureImportances, cols, spark, k)


def evaluate(scored: DataFrame, label: str = "closed") -> DataFrame:
    """Metric rows ``(metric, value)`` of a scored set: AUC, accuracy and
    class-1 precision/recall/F1 (long format).

    The scored set is written once when called, so each row is scored a single time.
    """
    ensure_checkpoint_dir(scored.sparkSession)
    scored = scored.select(label, "prediction", "p_closed").checkpoint(eager=True)
    auc = mt.roc_auc(scored, label, "p_closed").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    rep = mt.classification_report(scored, label, "prediction").where(F.col("label").isin("1", "accuracy"))
    pair = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
    rows = F.when(F.col("label") == "accuracy", F.array(pair("accuracy", "f1"))).otherwise(
        F.array(*[pair(f"{m}_1", m) for m in ("precision", "recall", "f1")]))
    return auc.unionByName(rep.select(F.explode(rows).alias("r")).select("r.*"))
