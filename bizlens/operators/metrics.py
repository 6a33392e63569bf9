"""Evaluation tables as distributed aggregations.

Inputs are prediction DataFrames (label, predicted class, P(positive)); only
the final metric tables are small.  Curves and the exact AUC need cumulative
counts over the score order.  A global ``Window.orderBy`` would run in one
task, so scores are first collapsed to distinct values (map-side combine),
then assigned to buckets cut at quantiles of those values; bucket totals are
prefix-summed on a table of at most ``SCORE_BUCKETS`` rows (broadcast, bounded)
and rows are accumulated inside their bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def confusion_matrix(pred: DataFrame, y: str, yhat: str, labels: Sequence[int] | None = None) -> DataFrame:
    """rows = true class, one ``pred_<label>`` column per predicted class, 0-filled.

    ``labels`` default to the classes found on either side.  Every label has a
    row, true classes beyond ``labels`` have theirs, and predictions beyond
    ``labels`` are counted in ``pred_other``.
    """
    if labels is None:
        found = pred.select(F.explode(F.array(y, yhat)).alias("k")).where("k IS NOT NULL").distinct()
        labels = sorted(r["k"] for r in found.collect())  # one row per class
    inside = F.coalesce(F.col(yhat).isin(list(labels)), F.lit(False))
    cells = [F.count(F.when(F.col(yhat) == lab, 1)).alias(f"pred_{lab}") for lab in labels] + [F.count(F.when(~inside, 1)).alias("pred_other")]
    got = pred.groupBy(F.col(y).alias("label")).agg(*cells)
    rows = pred.sparkSession.createDataFrame([(lab,) for lab in labels], "label long").select(F.col("label").cast(pred.schema[y].dataType))
    zero = rows.select("label", *[F.lit(0).cast("bigint").alias(f"pred_{c}") for c in [*labels, "other"]])
    both = got.unionByName(zero)
    return both.groupBy("label").agg(*[F.sum(f"pred_{c}").alias(f"pred_{c}") for c in [*labels, "other"]])


def classification_report(pred: DataFrame, y: str, yhat: str, digits: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg.

    One ``groupBy(y, yhat)`` over the data, then the K*K counts are gathered
    into one row and every metric is an expression over that array.  A zero
    denominator gives 0 (as the reference's report does).  Rows are keyed by
    ``label`` text: the class values, ``accuracy``, ``macro avg`` and ``weighted avg``.
    """
    cells = pred.groupBy(F.col(y).alias("t"), F.col(yhat).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    one = cells.agg(F.collect_list(F.struct("t", "p", "c")).alias("m"))  # K * K counts
    zero = F.lit(0).cast("bigint")

    def count(cond):
        return F.aggregate(F.filter("m", cond), zero, lambda a, x: a + x["c"])

    def safe_div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    classes = F.array_sort(F.array_distinct(F.concat(F.transform("m", lambda x: x["t"]), F.transform("m", lambda x: x["p"]))))
    per = one.withColumn("per", F.transform(classes, lambda k: F.struct(
        k.alias("k"), count(lambda x: x["t"].eqNullSafe(k)).alias("support"), count(lambda x: x["p"].eqNullSafe(k)).alias("predicted"),
        count(lambda x: x["t"].eqNullSafe(k) & x["p"].eqNullSafe(k)).alias("tp"))))
    per = per.withColumn("per", F.transform("per", lambda r: F.struct(
        r["k"].cast("string").alias("label"), safe_div(r["tp"], r["predicted"]).alias("precision"),
        safe_div(r["tp"], r["support"]).alias("recall"), r["support"].alias("support"), r["tp"].alias("tp"))))
    per = per.select(F.transform("per", lambda r: F.struct(
        r["label"].alias("label"), r["precision"].alias("precision"), r["recall"].alias("recall"),
        safe_div(2 * r["precision"] * r["recall"], r["precision"] + r["recall"]).alias("f1"),
        r["support"].alias("support"), r["tp"].alias("tp"))).alias("per"))

    def total(f, start=0.0):
        return F.aggregate("per", F.lit(start).cast("double"), lambda a, r: a + f(r).cast("double"))

    n, k = total(lambda r: r["support"]), F.size("per").cast("double")
    none = F.lit(None).cast("double")

    def summary(label, values):
        return F.struct(F.lit(label).alias("label"), *[v.alias(c) for c, v in zip(("precision", "recall", "f1"), values)], n.cast("bigint").alias("support"))

    metrics = ("precision", "recall", "f1")
    rows = F.concat(
        F.transform("per", lambda r: F.struct(r["label"].alias("label"), *[r[c].alias(c) for c in metrics], r["support"].alias("support"))),
        F.when(F.size("per") > 0, F.array(
            summary("accuracy", (none, none, total(lambda r: r["tp"]) / n)),
            summary("macro avg", [total(lambda r, c=c: r[c]) / k for c in metrics]),
            summary("weighted avg", [total(lambda r, c=c: r[c] * r["support"]) / n for c in metrics]))).otherwise(F.array()))
    out = per.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("label", *[F.round(c, digits).alias(c) for c in metrics], F.col("support").cast("bigint").alias("support"))


#: Quantile buckets of the distinct scores.
SCORE_BUCKETS = 1024


def score_counts(pred: DataFrame, y: str, p: str, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Per distinct score: positives, negatives, and the counts strictly below it.

    Rows without a label or a score count for neither class.  Buckets are cut at
    quantiles of the distinct scores, so however close the scores lie no task gets
    more than its share of them.  The counts of the distinct scores are written
    once when called: ``pred`` is read a single time.
    """
    known = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    s = (known.groupBy(F.col(p).cast("double").alias("score"))
         .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
              F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))
    ensure_checkpoint_dir(pred.sparkSession)
    s = s.checkpoint(eager=True)
    cuts = sorted(set(s.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    if cuts:
        s = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="score", outputCol="_b").transform(s)
    else:
        s = s.withColumn("_b", F.lit(0.0))
    tot = s.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    run = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    offs = tot.select("_b", (F.sum("_bp").over(run) - F.col("_bp")).alias("_op"),
                      (F.sum("_bn").over(run) - F.col("_bn")).alias("_on"),
                      F.sum("_bp").over(every).alias("n_pos"), F.sum("_bn").over(every).alias("n_neg"))
    inb = Window.partitionBy("_b").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offs has at most ``buckets`` rows (its windows run on that bounded table):
    # broadcasting it is bounded too.
    return (s.join(F.broadcast(offs), on="_b")
            .select("score", "pos", "neg",
                    (F.col("_op") + F.sum("pos").over(inb) - F.col("pos")).alias("pos_below"),
                    (F.col("_on") + F.sum("neg").over(inb) - F.col("neg")).alias("neg_below"),
                    "n_pos", "n_neg", "_b"))


def roc_auc(pred: DataFrame, y: str, p: str) -> DataFrame:
    """Exact, tie-aware ROC-AUC (one row; null when a class is absent).

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N), computed in
    integers as (2*sum pos*neg_below + sum pos*neg) / (2*P*N).
    """
    sc = score_counts(pred, y, p)
    num = F.sum(2 * F.col("pos") * F.col("neg_below") + F.col("pos") * F.col("neg"))
    P, N = F.sum("pos"), F.sum("neg")
    return sc.agg(F.when((P > 0) & (N > 0), num.cast("double") / (2 * P * N).cast("double")).alias("auc"),
                  P.alias("n_pos"), N.alias("n_neg"))


def roc_curve(pred: DataFrame, y: str, p: str, max_points: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (0, 0) start
    (threshold null = +infinity).  Collinear points are kept.  ``max_points``
    keeps the lowest score of each of so many quantile buckets."""
    sc = score_counts(pred, y, p, max_points or SCORE_BUCKETS)
    P, N = F.col("n_pos"), F.col("n_neg")
    pts = sc.select(F.col("score").alias("threshold"),
                    ((N - F.col("neg_below")) / N).alias("fpr"), ((P - F.col("pos_below")) / P).alias("tpr"), "_b")
    if max_points:
        pts = pts.groupBy("_b").agg(F.min(F.struct("threshold", "fpr", "tpr")).alias("r")).select("r.*")
    start = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts.select("threshold", "fpr", "tpr"))


def pr_curve(pred: DataFrame, y: str, p: str, until_full_recall: bool = False) -> DataFrame:
    """A10: (threshold, precision, recall) at every distinct score, plus the
    (recall 0, precision 1) end point.  ``until_full_recall`` leaves out the
    scores below the lowest positive one, where recall stays 1.
    """
    sc = score_counts(pred, y, p)
    tp = F.col("n_pos") - F.col("pos_below")
    fp = F.col("n_neg") - F.col("neg_below")
    if until_full_recall:
        sc = sc.where((F.col("pos_below") > 0) | (F.col("pos") > 0))
    pts = sc.select(
        F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.col("n_pos")).alias("recall"))
    end = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def score_histogram(pred: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Predicted-probability histogram per true class (bin = floor(p*bins), clamped)."""
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return pred.groupBy(F.col(y).alias("label"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def feature_importance(importances, cols: Sequence[str], spark, k: int = 20) -> DataFrame:
    """Top-k (feature, importance) from a fitted tree model's importances."""
    vals = importances.toArray().tolist() if hasattr(importances, "toArray") else list(importances)
    df = spark.createDataFrame(list(zip(cols, [float(v) for v in vals])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(k)
