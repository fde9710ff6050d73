import random

import pytest

from febrile.operators import evaluation as EV


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    good = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return good / (len(pos) * len(neg))


def test_published_stage2_report(spark):
    # truth/prediction pairs that give the published five-row report
    pairs = [("Dengue", "Dengue"), ("Dengue", "Typhoid"), ("Typhoid", "Viral"), ("Viral", "Viral"), ("Viral", "Dengue")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    rep = {r["label"]: r for r in EV.classification_report(df, "y_true", "y_pred").collect()}
    assert (rep["Dengue"]["precision"], rep["Dengue"]["recall"], rep["Dengue"]["f1_score"], rep["Dengue"]["support"]) \
        == (0.5, 0.5, 0.5, 2)
    assert (rep["Typhoid"]["precision"], rep["Typhoid"]["recall"], rep["Typhoid"]["f1_score"]) == (0.0, 0.0, 0.0)
    assert rep["accuracy"]["f1_score"] == pytest.approx(0.4) and rep["accuracy"]["support"] == 5
    m = EV.multiclass_metrics(df, "y_true", "y_pred").first()
    assert m["accuracy"] == pytest.approx(0.4)
    assert m["f1_macro"] == pytest.approx(1 / 3)
    assert m["f1_weighted"] == pytest.approx(0.4)
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in EV.confusion_matrix(df, "y_true", "y_pred").collect()}
    assert sum(cm.values()) == 5 and min(cm.values()) > 0 and ("Typhoid", "Typhoid") not in cm


def test_auc_matches_pair_count_with_ties(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 20) / 20.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = EV.roc_auc(df, "y", "s").first()[0]
    assert got == pytest.approx(_brute_auc(rows), abs=1e-12)


def test_published_stage1_auc_shape(spark):
    # 4 positives x 16 negatives, 59 of 64 pairs ordered -> 0.921875
    pos = [0.9, 0.8, 0.7, 0.3]
    neg = [0.1] * 11 + [0.2, 0.25, 0.5, 0.6, 0.65]
    rows = [(1, s) for s in pos] + [(0, s) for s in neg]
    df = spark.createDataFrame(rows, "y int, s double")
    assert EV.roc_auc(df, "y", "s").first()[0] == pytest.approx(_brute_auc(rows))


def test_roc_points_end_at_one(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in
                 EV.roc_curve_points(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect())
    assert pts[0] == (0.1, 1.0, 1.0) and pts[-1] == (0.9, 0.0, 0.5)


def test_binary_metrics_undefined_f1_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = EV.binary_metrics(df, "y", "p").first()
    assert (r["accuracy"], r["f1"]) == (1.0, 0.0)


def test_auc_agrees_with_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from conftest import SF_SMALL
    from febrile.sources import fixtures as fx
    ev = fx.evaluated(spark, SF_SMALL).selectExpr("CAST(y_bin AS DOUBLE) AS label", "score")
    ours = EV.roc_auc(ev, "label", "score").first()[0]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                           numBins=0).evaluate(ev)
    assert ours == pytest.approx(theirs, abs=1e-12)


PUBLISHED_REPORT = (
    "              precision    recall  f1-score   support\n"
    "\n"
    "      Dengue       0.50      0.50      0.50         2\n"
    "     Typhoid       0.00      0.00      0.00         1\n"
    "       Viral       0.50      0.50      0.50         2\n"
    "\n"
    "    accuracy                           0.40         5\n"
    "   macro avg       0.33      0.33      0.33         5\n"
    "weighted avg       0.40      0.40      0.40         5\n")
