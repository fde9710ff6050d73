"""Registered queries for model preparation, training, scoring and evaluation.

Preparation queries fit on the labelled observations (every row with an
outbreak label); evaluation queries read the ``evaluated`` table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from febrile.config import JobConfig
from febrile.operators import evaluation as EV
from febrile.operators import forest as FT
from febrile.operators import ml_models as M
from febrile.operators import ml_prep as MP
from febrile.operators.filters import drop_null_labels
from febrile.operators.prefix import exclusive_prefix_sums
from febrile.plans import scoring_job as SJ
from febrile.session import scratch_path
from febrile.sources import fixtures as fx

NUM = ["feat_chars", "feat_spaces"]
CAT = ["feat_lang"]
CFG = JobConfig()


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return drop_null_labels(fx.observations(spark, d), CFG.label_outbreak)


# ------------------------------------------------------------------ preparation
def q_stratified_split(spark, d):
    s = MP.stratified_split(_labelled(spark, d), CFG.label_outbreak, CFG.order_col, CFG.test_size, CFG.random_state)
    return s.select("row_seq", CFG.label_outbreak, "split")


def q_impute_median(spark, d):
    return _r6(MP.exact_medians(_labelled(spark, d), NUM), "median")


def q_standard_scale(spark, d):
    lab = _labelled(spark, d)
    med = {r["feature"]: r["median"] for r in MP.exact_medians(lab, NUM).collect()}
    return _r6(MP.numeric_moments(lab, NUM, med), "mean", "scale")


def q_impute_mode(spark, d):
    return MP.categorical_modes(_labelled(spark, d), CAT)


def q_one_hot_ignore_unknown(spark, d):
    prep = MP.fit_preprocessor(_labelled(spark, d), NUM, CAT)
    out = MP.one_hot_index(prep.transform(fx.observations(spark, d)), "feat_lang")
    return out.select("row_seq", F.col("__cat_feat_lang").alias("feat_lang_filled"), "feat_lang_hot_index")


def q_assemble_features(spark, d):
    prep = MP.fit_preprocessor(_labelled(spark, d), NUM, CAT)
    slots = F.transform(vector_to_array(F.col(MP.FEATURES)), lambda x: F.round(x, 6))
    return prep.transform(fx.observations(spark, d)).select("row_seq", slots.alias("features"))


# ------------------------------------------------------------------ training / scoring
# Fitted trees and coefficients differ between engines, so these queries recompute from the fitted parts what the model
# claims: the gradient of its objective, the probabilities and importances that follow from its nodes, and the metrics of
# its scored test rows.  A flag is true where both agree.
def _obs(spark, d):
    return fx.observations(spark, d)


def _stage1(spark, d) -> SJ.Stage1:
    obs = _obs(spark, d)
    return SJ.stage1(obs, *SJ.feature_columns(obs, CFG), CFG)


def _stage2(spark, d, cfg: JobConfig = CFG) -> SJ.Stage2:
    obs = _obs(spark, d)
    return SJ.stage2(obs, *SJ.feature_columns(obs, cfg), cfg)


def _part_rows(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("row_seq", F.col(label).cast("string").alias("class"), "split")


def _certified(one: SJ.Stage1) -> bool:
    """Whether the gradient is zero, up to its bound, by every coefficient and the intercept."""
    c = M.gradient_certificate(one.model, one.train, CFG)
    return bool(c.agg(F.bool_and(F.abs("gradient") <= F.col("bound"))).first()[0])


def q_train_outbreak_model(spark, d):
    """Per coefficient: its gradient is zero up to the bound; the coefficients and intercept themselves, to 3 digits."""
    one = _stage1(spark, d)
    c = M.gradient_certificate(one.model, one.train, CFG)
    return c.select("feature", (F.abs("gradient") <= F.col("bound")).alias("at_optimum"), (F.round("coefficient", 3) + 0.0).alias("coefficient"))


def _forest_probabilities(two: SJ.Stage2) -> DataFrame:
    """row_seq, probs of the test rows, from the node table alone."""
    model = two.model.model
    rows = PipelineModel(stages=model.stages[:-1]).transform(two.test)
    rows = rows.select(F.col("row_seq").alias("id"), vector_to_array(F.col(MP.FEATURES)).alias("features"))
    return FT.class_probabilities(FT.node_table(model.stages[-1], two.train.sparkSession), rows).withColumnRenamed("id", "row_seq")


def _boosted_probabilities(two: SJ.Stage2) -> DataFrame:
    """row_seq, probs of the test rows: per class the logistic of twice the weighted sum of leaf values, then normalised."""
    model, spark = two.model.model, two.train.sparkSession
    k = len(two.model.classes)
    rows = PipelineModel(stages=model.stages[:-k]).transform(two.test)
    rows = rows.select(F.col("row_seq").alias("id"), vector_to_array(F.col(MP.FEATURES)).alias("features"))
    out = None
    for i, stage in enumerate(model.stages[-k:]):
        weights = F.array(*[F.lit(float(w)) for w in stage.treeWeights])
        one = FT.leaves(FT.node_table(stage, spark), rows).groupBy("id").agg(
            F.sum(F.col("prediction") * F.element_at(weights, F.col("tree") + 1)).alias("margin"))
        one = one.select("id", F.struct(F.lit(i).alias("class"), (1 / (1 + F.exp(-2 * F.col("margin")))).alias("p")).alias("x"))
        out = one if out is None else out.unionByName(one)
    probs = out.groupBy(F.col("id").alias("row_seq")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return probs.select("row_seq", F.transform("raw", lambda x: x / total).alias("probs"))


def _type_rows(two: SJ.Stage2, own: DataFrame) -> DataFrame:
    """The rows of both parts; for test rows, whether the model's probabilities follow from its nodes and sum to one."""
    model = M.class_probabilities(two.model, two.test).select("row_seq", F.col(M.PROBS))
    met = model.join(own, "row_seq", "left")
    far = F.exists(F.arrays_zip(M.PROBS, "probs"), lambda z: z[M.PROBS].isNull() | z["probs"].isNull() | (F.abs(z[M.PROBS] - z["probs"]) > 1e-9))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    checked = met.select("row_seq", F.coalesce(~far & (F.abs(total - 1) < 1e-9), F.lit(False)).alias("from_nodes"))
    return _part_rows(two.train, two.test, CFG.label_type).join(checked, "row_seq", "left")


def q_train_type_forest(spark, d):
    two = _stage2(spark, d)
    sound = FT.consistent(FT.node_table(two.model.model.stages[-1], spark)).first()[0]
    return _type_rows(two, _forest_probabilities(two)).withColumn("consistent", F.lit(bool(sound)))


def q_train_type_boosted(spark, d):
    two = _stage2(spark, d, JobConfig(use_boosting=True))
    return _type_rows(two, _boosted_probabilities(two))


def q_score_outbreak(spark, d):
    """P_Outbreak of every row, to 3 digits; whether it is the logistic of the coefficients, and those are at the optimum."""
    one = _stage1(spark, d)
    obs = _obs(spark, d)
    weights = [w for _, w in M.coefficients(one.model, obs)]
    array = F.array(*[F.lit(w) for w in weights[:-1]])
    margin = F.aggregate(F.zip_with(vector_to_array(F.col(MP.FEATURES)), array, lambda x, w: x * w), F.lit(weights[-1]), lambda a, x: a + x)
    out = M.score_outbreak(one.model, obs).withColumn("own", 1 / (1 + F.exp(-margin)))
    return out.select("row_seq", F.round("P_Outbreak", 3).alias("p_outbreak"), (F.abs(F.col("own") - F.col("P_Outbreak")) < 1e-12).alias("logistic"),
                      F.lit(_certified(one)).alias("at_optimum"))


def q_score_type(spark, d):
    probs = fx.class_probabilities(spark, d)
    gated = M.gate_type(probs, "P_Outbreak", "class_probs", fx.FEVER_CLASSES, CFG.threshold)
    return gated.select("row_seq", "Region", "P_Outbreak", "Fever_Type", "P_Type", "Severity_Index")


def q_run_two_stage_scoring(spark, d):
    s = SJ.run_two_stage(_obs(spark, d), CFG).scored
    over = F.col("P_Outbreak") >= CFG.threshold
    known = F.col("Fever_Type").isin(*fx.FEVER_CLASSES)
    return s.select("row_seq", "Region", F.col("P_Outbreak").between(0, 1).alias("in_range"),
                    ((over & known & (F.col("P_Type") > 0)) | (~over & (F.col("Fever_Type") == "None") & (F.col("P_Type") == 0))).alias("gated"),
                    (F.abs(F.col("Severity_Index") - F.col("P_Outbreak") * F.col("P_Type")) < 1e-12).alias("product"))


def q_save_model(spark, d):
    """Both saved models, loaded again, give every row the scores it had before; the type model brings its class names."""
    obs, cfg = _obs(spark, d), CFG
    result = SJ.run_two_stage(obs, cfg)
    path = scratch_path(spark, "models")
    SJ.save_models(result, path)
    outbreak, of_type = PipelineModel.load(f"{path}/outbreak_model"), M.TypeModel.load(spark, f"{path}/fever_type_model")
    num, cat = result.info["num_cols"], result.info["cat_cols"]
    names = {c: f"{c}_before" for c in ("P_Outbreak", "Fever_Type", "P_Type", "Severity_Index")}
    met = result.scored.withColumnsRenamed(names).join(SJ.score_all(obs, outbreak, of_type, num, cat, cfg), "row_seq")
    same = lambda c: F.col(c).eqNullSafe(F.col(names[c]))
    return met.select("row_seq", same("P_Outbreak").alias("same_outbreak"), (same("Fever_Type") & same("P_Type") & same("Severity_Index")).alias("same_type"))


def q_write_metrics(spark, d):
    """The written metrics, read back, beside their values by other formulas over the written test rows."""
    path = scratch_path(spark, "metrics")
    SJ.write_metrics(SJ.run_two_stage(_obs(spark, d), CFG), path)
    back = spark.read.schema("stage string, metric string, value double").json(f"{path}/metrics")
    rows = spark.read.schema("stage string, row_seq long, y_true string, y_pred string, score double").json(f"{path}/test_predictions")
    return back.join(_metrics_again(rows), ["stage", "metric"], "left").select(
        "stage", "metric", F.coalesce(F.abs(F.col("value") - F.col("again")) < 1e-9, F.lit(False)).alias("agrees"))


def _metrics_again(rows: DataFrame) -> DataFrame:
    """stage, metric, again: the area as the mean rank of positives (Mann and Whitney), F1 from precision and recall."""
    one = rows.filter("stage = 'stage1'").withColumn("y", F.col("y_true").cast("int"))
    pos, neg = one.filter("y = 1").groupBy("score").count(), one.filter("y = 0").groupBy("score").count()
    sizes = one.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    # distinct scores of the test part against each other would be a cross join: rank them instead
    scores = pos.select("score", F.col("count").alias("p"), F.lit(0).alias("n")).unionByName(neg.select("score", F.lit(0).alias("p"), F.col("count").alias("n")))
    scores = scores.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), (F.sum("p") + F.sum("n")).alias("m"))
    ranked = exclusive_prefix_sums(scores, [], ["score"], ["m"])
    ranks = F.sum(F.col("p") * (F.col("m_before") + (F.col("m") + 1) / 2.0))
    area = ranked.agg(((ranks - sizes["p"] * (sizes["p"] + 1) / 2.0) / (sizes["p"] * sizes["n"])).alias("again"))
    metric = lambda df, stage, name: df.select(F.lit(stage).alias("stage"), F.lit(name).alias("metric"), F.col("again").cast("double"))
    hits = rows.groupBy("stage").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("again"))
    out = metric(area, "stage1", "roc_auc").unionByName(hits.select("stage", F.lit("accuracy").alias("metric"), "again"))
    labels = rows.select("stage", F.col("y_true").alias("c")).union(rows.select("stage", "y_pred")).distinct()
    true = rows.groupBy("stage", F.col("y_true").alias("c")).agg(F.count("*").alias("support"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("tp"))
    said = rows.groupBy("stage", F.col("y_pred").alias("c")).agg(F.count("*").alias("said"))
    each = labels.join(true, ["stage", "c"], "left").join(said, ["stage", "c"], "left").na.fill(0)
    precision, recall = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    two = each.filter("stage = 'stage2'")
    out = out.unionByName(metric(each.filter("stage = 'stage1' AND c = '1'").withColumnRenamed("f1", "again"), "stage1", "f1"))
    out = out.unionByName(metric(two.agg(F.avg("f1").alias("again")), "stage2", "f1_macro"))
    return out.unionByName(metric(two.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("again")), "stage2", "f1_weighted"))


def _importances_beside(two: SJ.Stage2) -> DataFrame:
    """feature, importance, from_nodes: the model's importances beside the sums over its nodes."""
    spark = two.train.sparkSession
    names = M.feature_names(PipelineModel(stages=two.model.model.stages[:-1]).transform(two.train.limit(0)))
    named = spark.createDataFrame(list(enumerate(names)), "number int, feature string")
    own = FT.importances(FT.node_table(two.model.model.stages[-1], spark)).select(F.col("feature").alias("number"), F.col("importance").alias("from_nodes"))
    return two.importances.join(named.join(own, "number", "left").na.fill(0.0, ["from_nodes"]), "feature", "left")


def q_feature_importances(spark, d):
    """Importances by feature: none negative, together one, each the sum of its nodes' gains."""
    imp = _importances_beside(_stage2(spark, d))
    total = imp.agg(F.sum("importance")).first()[0]
    return imp.select("feature", (F.col("importance") >= 0).alias("in_range"), F.lit(abs(total - 1) < 1e-9).alias("sum_is_one"),
                      F.coalesce(F.abs(F.col("importance") - F.col("from_nodes")) < 1e-9, F.lit(False)).alias("from_nodes"))


def q_top20_feature_importances(spark, d):
    """The most important features; the place of each is the number of features whose nodes gain more, and one."""
    beside = _importances_beside(_stage2(spark, d))
    top = M.top_feature_importances(beside.select("feature", "importance"), 20)
    ordered = top.withColumn("place", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    by_nodes = beside.withColumn("own_place", F.row_number().over(Window.orderBy(F.round("from_nodes", 9).desc(), "feature")))
    return ordered.join(by_nodes.select("feature", "own_place"), "feature").select("feature", (F.col("place") == F.col("own_place")).alias("in_place"))


# ------------------------------------------------------------------ evaluation
def _ev(spark, d):
    return fx.evaluated(spark, d)


def q_threshold_predict(spark, d):
    return EV.with_threshold_prediction(_ev(spark, d), "score", CFG.threshold).select("row_id", "y_bin", "score", "y_hat")


def q_roc_auc(spark, d):
    return _r6(EV.roc_auc(_ev(spark, d), "y_bin", "score"), "roc_auc")


def q_roc_curve_points(spark, d):
    return EV.roc_curve_points(_ev(spark, d), "y_bin", "score")


def _bin(spark, d):
    return EV.binary_metrics(EV.with_threshold_prediction(_ev(spark, d), "score", CFG.threshold), "y_bin", "y_hat")


def q_accuracy(spark, d):
    return _r6(_bin(spark, d).select("accuracy"), "accuracy")


def q_f1_binary(spark, d):
    return _r6(_bin(spark, d).select("f1"), "f1")


def q_f1_macro(spark, d):
    return _r6(EV.multiclass_metrics(_ev(spark, d), "y_true", "y_pred").select("f1_macro"), "f1_macro")


def q_f1_weighted(spark, d):
    return _r6(EV.multiclass_metrics(_ev(spark, d), "y_true", "y_pred").select("f1_weighted"), "f1_weighted")


def q_classification_report(spark, d):
    return _r6(EV.classification_report(_ev(spark, d), "y_true", "y_pred"), "precision", "recall", "f1_score")


def q_confusion_matrix(spark, d):
    return EV.confusion_matrix(_ev(spark, d), "y_true", "y_pred")


def ml_queries() -> dict:
    return {
        "stratified_split": q_stratified_split,
        "impute_median": q_impute_median,
        "standard_scale": q_standard_scale,
        "impute_mode": q_impute_mode,
        "one_hot_ignore_unknown": q_one_hot_ignore_unknown,
        "assemble_features": q_assemble_features,
        "train_outbreak_model": q_train_outbreak_model,
        "train_type_forest": q_train_type_forest,
        "train_type_boosted": q_train_type_boosted,
        "score_outbreak": q_score_outbreak,
        "score_type": q_score_type,
        "save_model": q_save_model,
        "write_metrics": q_write_metrics,
        "run_two_stage_scoring": q_run_two_stage_scoring,
        "feature_importances": q_feature_importances,
        "top20_feature_importances": q_top20_feature_importances,
        "threshold_predict": q_threshold_predict,
        "roc_auc": q_roc_auc,
        "roc_curve_points": q_roc_curve_points,
        "accuracy": q_accuracy,
        "f1_binary": q_f1_binary,
        "f1_macro": q_f1_macro,
        "f1_weighted": q_f1_weighted,
        "classification_report": q_classification_report,
        "confusion_matrix": q_confusion_matrix,
    }
