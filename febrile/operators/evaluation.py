"""Model evaluation as table operators over (truth, prediction, score) rows.

Binary metrics follow the usual definitions with 0 where a ratio is
undefined; ROC ties are averaged (all rows sharing a score form one step).
Multiclass metrics use the union of labels seen in truth or prediction.
Every metric is an aggregate with partial (map-side) combination; the ROC
cumulative counts use the range-partitioned prefix sum, never a
single-partition window over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import threshold_predict
from febrile.operators.prefix import exclusive_prefix_sums

def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def with_threshold_prediction(df: DataFrame, score: str, threshold: float, out: str = "y_hat") -> DataFrame:
    return df.withColumn(out, threshold_predict(score, threshold))


# ------------------------------------------------------------------ binary
def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score."""
    y = F.col(label)
    return (df.groupBy(F.col(score).alias("score"))
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def ordered_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """``score_counts`` with the counts at smaller scores and in total: what the curve and the area are made of."""
    return exclusive_prefix_sums(score_counts(df, label, score), [], ["score"], ["pos", "neg"])


def roc_curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score: predict 1 when score >= threshold."""
    return points_of(ordered_counts(df, label, score))


def points_of(pref: DataFrame) -> DataFrame:
    return pref.select(F.col("score").alias("threshold"),
                       _ratio(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
                       _ratio(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (one row); null when a class is absent.

    Mis-ordered pairs: for each negative at score s, positives strictly below
    s count 1 and positives at s count 1/2.
    """
    return area_of(ordered_counts(df, label, score))


def area_of(pref: DataFrame) -> DataFrame:
    neg, pos_b, pos = (F.col(c).cast("double") for c in ("neg", "pos_before", "pos"))
    agg = pref.agg(F.sum(neg * pos_b + neg * pos * F.lit(0.5)).alias("bad"),
                   F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"))
    return agg.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.lit(1.0) - F.col("bad") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def binary_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy and F1 of class 1."""
    y, p = F.col(label), F.col(pred)
    tp, fp, fn = F.count_if((y == 1) & (p == 1)), F.count_if((y != 1) & (p == 1)), F.count_if((y == 1) & (p != 1))
    return df.agg(_ratio(F.count_if(y == p), F.count(F.lit(1))).alias("accuracy"),
                  _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"))


# ------------------------------------------------------------------ multiclass
def per_class_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(label, support, predicted, tp) over labels seen in truth or prediction.

    Each row contributes once as truth and once as prediction; one grouped
    aggregate with map-side combination computes all three counts.
    """
    t, p = F.col(y_true).cast("string"), F.col(y_pred).cast("string")
    both = F.array(F.struct(t.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                            (t == p).cast("int").alias("tp")),
                   F.struct(p.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    return (df.select(F.explode(both).alias("x")).select("x.*")
              .groupBy("label").agg(F.sum("t").cast("bigint").alias("support"),
                                    F.sum("p").cast("bigint").alias("predicted"),
                                    F.sum("tp").cast("bigint").alias("tp")))


def _class_scores(counts: DataFrame) -> DataFrame:
    return counts.select("label", "support",
                         _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                         _ratio(F.col("tp"), F.col("support")).alias("recall"),
                         _ratio(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
                         "tp")


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    cls = _class_scores(per_class_counts(df, y_true, y_pred))
    sup = F.col("support").cast("double")
    tot = F.sum("support")
    summary = cls.agg(
        _ratio(F.sum("tp"), tot).alias("accuracy"), tot.alias("total"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        _ratio(F.sum(F.col("precision") * sup), tot).alias("wp"),
        _ratio(F.sum(F.col("recall") * sup), tot).alias("wr"),
        _ratio(F.sum(F.col("f1_score") * sup), tot).alias("wf"))
    def row(label, prec, rec, f1):
        return F.struct(F.lit(label).alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.alias("f1_score"), F.col("total").alias("support"))

    acc_row, macro_row, weighted_row = C.REPORT_SUMMARY_ROWS
    rows = F.array(row(acc_row, F.lit(None), F.lit(None), F.col("accuracy")),
                   row(macro_row, F.col("mp"), F.col("mr"), F.col("mf")),
                   row(weighted_row, F.col("wp"), F.col("wr"), F.col("wf")))
    summary_rows = summary.select(F.explode(rows).alias("r")).select("r.*")
    return cls.select("label", "precision", "recall", "f1_score", "support").unionByName(summary_rows)


def multiclass_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row: accuracy, macro F1 and weighted F1."""
    cls = _class_scores(per_class_counts(df, y_true, y_pred))
    tot = F.sum("support")
    return cls.agg(_ratio(F.sum("tp"), tot).alias("accuracy"),
                   F.coalesce(F.avg("f1_score"), F.lit(0.0)).alias("f1_macro"),
                   _ratio(F.sum(F.col("f1_score") * F.col("support").cast("double")), tot).alias("f1_weighted"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y_true, y_pred, n) for every pair of labels that occurs; absent pairs count zero."""
    t, p = F.col(y_true).cast("string"), F.col(y_pred).cast("string")
    return df.groupBy(t.alias("y_true"), p.alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
