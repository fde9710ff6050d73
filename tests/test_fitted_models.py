"""What the queries recompute from fitted models: optimum, nodes, samples, saved artefacts."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF_SMALL
from febrile.config import JobConfig
from febrile.operators import forest as FT
from febrile.operators import ml_models as M
from febrile.plans import catalog_ml as K
from febrile.plans import scoring_job as SJ
from febrile.sources import fixtures as fx


@pytest.fixture(scope="module")
def two(spark):
    return K._stage2(spark, SF_SMALL)


def _constant(monkeypatch):
    """Every logistic regression is fitted under a penalty that leaves the intercept alone."""
    fit = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, data: fit(self.copy().setRegParam(1e9), data))


def test_a_constant_outbreak_model_turns_both_queries_red(spark, monkeypatch):
    good = {r["feature"]: r["at_optimum"] for r in K.q_train_outbreak_model(spark, SF_SMALL).collect()}
    assert all(good.values()) and M.INTERCEPT in good
    assert all(r["at_optimum"] and r["logistic"] for r in K.q_score_outbreak(spark, SF_SMALL).collect())
    _constant(monkeypatch)
    assert not all(r["at_optimum"] for r in K.q_train_outbreak_model(spark, SF_SMALL).collect())
    assert not any(r["at_optimum"] for r in K.q_score_outbreak(spark, SF_SMALL).collect())


def test_gradient_is_that_of_the_objective(spark):
    """The certificate's sums against plain Python over the same rows."""
    import math
    one = K._stage1(spark, SF_SMALL)
    rows = M.score_outbreak(one.model, one.train).select("features", "P_Outbreak", "outbreak_label").collect()
    own = {r["feature"]: r for r in M.gradient_certificate(one.model, one.train, JobConfig()).collect()}
    weights = M.coefficients(one.model, one.train)
    for j, (name, w) in enumerate(weights):
        x = [1.0 if name == M.INTERCEPT else float(r["features"][j]) for r in rows]
        g = math.fsum((r["P_Outbreak"] - r["outbreak_label"]) * v for r, v in zip(rows, x, strict=True))
        assert own[name]["gradient"] == pytest.approx(g + (0 if name == M.INTERCEPT else w), abs=1e-9)


def test_node_table_gives_probabilities_and_importances(two, spark):
    nodes = FT.node_table(two.model.model.stages[-1], spark)
    assert FT.consistent(nodes).first()[0]
    assert all(r["from_nodes"] for r in K._type_rows(two, K._forest_probabilities(two)).filter("split = 'test'").collect())
    imp = {r["feature"]: r for r in K._importances_beside(two).collect()}
    assert all(abs(r["importance"] - r["from_nodes"]) < 1e-9 for r in imp.values()) and len(imp) > 2


def test_permuted_importances_and_broken_nodes_fail(two, spark, monkeypatch):
    values = sorted(two.importances.collect())
    turned = [(a["feature"], b["importance"]) for a, b in zip(values, values[1:] + values[:1], strict=True)]
    wrong = SJ.Stage2(**{**two.__dict__, "importances": spark.createDataFrame(turned, "feature string, importance double")})
    monkeypatch.setattr(K, "_stage2", lambda spark, d: wrong)
    assert not all(r["from_nodes"] for r in K.q_feature_importances(spark, SF_SMALL).collect())
    assert not all(r["in_place"] for r in K.q_top20_feature_importances(spark, SF_SMALL).collect())
    nodes = FT.node_table(two.model.model.stages[-1], spark)
    swapped = nodes.withColumns({"left": F.col("right"), "right": F.col("left")})
    rows = K.PipelineModel(stages=two.model.model.stages[:-1]).transform(two.test).select(
        F.col("row_seq").alias("id"), K.vector_to_array("features").alias("features"))
    checked = K._type_rows(two, FT.class_probabilities(swapped, rows).withColumnRenamed("id", "row_seq"))
    assert not all(r["from_nodes"] for r in checked.filter("split = 'test'").collect())
    assert not FT.consistent(nodes.withColumn("left", F.when(F.col("left") >= 0, F.lit(0)).otherwise(F.col("left")))).first()[0]


def test_boosted_probabilities_follow_from_nodes(spark):
    cfg = JobConfig(use_boosting=True, gbt_rounds=6)
    boosted = K._stage2(spark, SF_SMALL, cfg)
    assert all(r["from_nodes"] for r in K._type_rows(boosted, K._boosted_probabilities(boosted)).filter("split = 'test'").collect())


def test_a_small_class_is_fitted_whole(spark):
    df = spark.range(40_000).select(F.col("id").alias("row_seq"), F.when(F.col("id") < 30, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    few = M.fit_sample(df, "y", JobConfig(max_fit_rows=4_000, min_fit_rows_per_class=50))
    sizes = {r["y"]: (r["n"], r["w"]) for r in few.groupBy("y").agg(F.count("*").alias("n"), F.sum(M.WEIGHT).alias("w")).collect()}
    assert sizes["rare"] == (30, 30.0)
    for c, n in df.filter("row_seq >= 30").groupBy("y").count().collect():
        assert abs(sizes[c][0] - n / 10) < 150 and abs(sizes[c][1] - n) < 1_500     # weights give the proportions back
    all_rows = M.fit_sample(df, "y", JobConfig(max_fit_rows=40_000))
    assert all_rows.count() == 40_000 and all_rows.filter(F.col(M.WEIGHT) != 1).count() == 0


def test_a_sample_gives_nearly_the_model_of_all_rows(spark):
    x = F.rand(3)
    df = spark.range(30_000).select(F.col("id").alias("row_seq"), x.alias("x"), F.lit("k").alias("k"))
    df = df.withColumn("y", (F.rand(4) < 0.02 + 0.1 * F.col("x")).cast("int")).checkpoint()
    fit = lambda **k: [w for _, w in M.coefficients(M.train_outbreak_model(df, ["x"], ["k"], JobConfig(label_outbreak="y", **k)), df)]
    whole, part = fit(), fit(max_fit_rows=6_000, min_fit_rows_per_class=2_500)
    assert abs(whole[0] - part[0]) < 0.15 and abs(whole[-1] + whole[1] - part[-1] - part[1]) < 0.15


def test_saved_models_score_alike_in_a_new_session(spark, scratch):
    obs = fx.observations(spark, SF_SMALL)
    for cfg in (JobConfig(rf_num_trees=20), JobConfig(use_boosting=True, gbt_rounds=3)):
        result = SJ.run_two_stage(obs, cfg)
        path = f"{scratch}/{result.type_model.name}"
        SJ.save_models(result, path)
        fresh = spark.newSession()
        again = M.TypeModel.load(fresh, f"{path}/fever_type_model")
        assert (again.classes, again.name) == (result.type_model.classes, result.type_model.name)
        outbreak = M.PipelineModel.load(f"{path}/outbreak_model")
        scored = SJ.score_all(fx.observations(fresh, SF_SMALL), outbreak, again, result.info["num_cols"], result.info["cat_cols"], cfg)
        assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, result.scored.collect()))


def test_metrics_cover_the_whole_test_part_and_wrong_ones_show(spark, monkeypatch):
    obs = fx.observations(spark, SF_SMALL)
    result = SJ.run_two_stage(obs, JobConfig(max_fit_rows=40, min_fit_rows_per_class=10, rf_num_trees=10))
    labelled = obs.filter("outbreak_label is not null").count()
    assert result.test_scores.filter("stage = 'stage1'").count() == -(-labelled // 5)
    assert result.confusion.filter("stage = 'stage1'").agg(F.sum("n")).first()[0] == -(-labelled // 5)
    monkeypatch.setattr(SJ.EV, "area_of", lambda counts: counts.agg(F.lit(0.5).alias("roc_auc")))
    wrong = {(r["stage"], r["metric"]): r["agrees"] for r in K.q_write_metrics(spark, SF_SMALL).collect()}
    assert not wrong["stage1", "roc_auc"] and sum(wrong.values()) == 5


def test_boosted_fit_is_dealt_by_its_rows(spark, monkeypatch):
    seen, fit = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    train = spark.createDataFrame([(i, float(i % 17), "ab"[i % 2], "xy"[i % 3 > 0]) for i in range(200)],
                                  "row_seq long, num double, cat string, fever_type string").repartition(16)
    model = M.train_type_boosted(train, ["num"], ["cat"], JobConfig(gbt_rounds=2))
    assert model.classes == ["x", "y"] and seen == [1, 1]


def test_boosted_trees_are_fitted_on_all_rows(spark, monkeypatch):
    """Whatever ``max_fit_rows`` says: every class sees every row once, unweighted, and the trees are those without a limit."""
    seen, fit = [], M.GBTClassifier.fit
    totals = lambda df: df.agg(F.count("*"), F.sum(M.WEIGHT), F.count_distinct(M.FEATURES)).first()
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: seen.append(tuple(totals(df))) or fit(self, df))
    train = spark.createDataFrame([(i, float(i), "ab"[i % 2], "xyz"[i % 5 % 3]) for i in range(600)],
                                  "row_seq long, num double, cat string, fever_type string")
    trees = lambda **k: [s.toDebugString.partition("\n")[2] for s in M.train_type_boosted(train, ["num"], ["cat"], JobConfig(
        gbt_rounds=2, gbt_subsample=1.0, **k)).model.stages[-3:]]
    assert trees(max_fit_rows=60, min_fit_rows_per_class=10) == trees()
    assert seen == [(600, 600.0, 600)] * 6


def test_boosted_tasks_grow_slower_than_the_rows():
    assert [M._boost_tasks(n) for n in (0, 1, 20_000, 20_001, 1_000_000)] == [1, 1, 1, 2, 50]
    assert [M._boost_tasks(n) for n in (1_280_001, 12_800_000, 12_800_001, 1_000_000_000)] == [64, 64, 65, 5_000]
