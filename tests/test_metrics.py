"""Metric tables against MLlib evaluators and brute force."""
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from bizlens.operators import metrics as mt


def _pred(spark):
    rows = [(i, 1 if (i * 7) % 10 < 3 else 0, round(((i * 37) % 101) / 100.0, 2)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, y int, p double")


def _brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_exact_and_matches_mllib(spark):
    df = _pred(spark)
    rows = [tuple(r) for r in df.collect()]
    auc = mt.roc_auc(df, "y", "p").first().auc
    assert abs(auc - _brute_auc(rows)) < 1e-12
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", metricName="areaUnderROC", numBins=0)
    assert abs(auc - ev.evaluate(df.withColumn("y", F.col("y").cast("double")))) < 1e-9


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert mt.roc_auc(df, "y", "p").first().auc is None


def test_roc_and_pr_curves(spark):
    df = _pred(spark)
    roc = mt.roc_curve(df, "y", "p").collect()
    assert any(r.threshold is None and r.fpr == 0.0 and r.tpr == 0.0 for r in roc)
    assert max(r.fpr for r in roc) == 1.0 and max(r.tpr for r in roc) == 1.0
    pr = mt.pr_curve(df, "y", "p").collect()
    end = [r for r in pr if r.threshold is None]
    assert len(end) == 1 and end[0].precision == 1.0 and end[0].recall == 0.0
    full = [r for r in pr if r.threshold is not None and r.recall == 1.0]
    assert len(full) == 1  # curve stops at the first threshold reaching full recall


def test_classification_report_and_confusion(spark):
    df = _pred(spark).withColumn("yhat", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    rows = [tuple(r) for r in df.select("y", "yhat").collect()]
    rep = {r.label: r for r in mt.classification_report(df, "y", "yhat").collect()}
    for k in (0, 1):
        tp = sum(1 for y, h in rows if y == k and h == k)
        prec = tp / max(1, sum(1 for _, h in rows if h == k))
        rec = tp / sum(1 for y, _ in rows if y == k)
        assert abs(rep[str(k)].precision - round(prec, 6)) < 1e-9
        assert abs(rep[str(k)].recall - round(rec, 6)) < 1e-9
    assert rep["accuracy"].support == 500
    cm = {r.label: (r.pred_0, r.pred_1) for r in mt.confusion_matrix(df, "y", "yhat").collect()}
    assert sum(a + b for a, b in cm.values()) == 500
    assert cm[1][1] == sum(1 for y, h in rows if y == 1 and h == 1)


def test_zero_denominator_gives_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, yhat int")
    rep = {r.label: r for r in mt.classification_report(df, "y", "yhat").collect()}
    assert rep["1"].precision == 0.0 and rep["1"].f1 == 0.0
