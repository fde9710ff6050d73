"""Model training and scoring with Spark ML.

Stage 1: L2 logistic regression (lbfgs, 200 iterations); the penalty of an
unscaled C = 1 objective is ``regParam = 1 / n_train`` in Spark's averaged
loss.  Stage 2: a random forest (400 trees, depth capped at Spark's maximum
of 30, sqrt feature sampling) or, optionally, one boosted-tree model per
class with the class probabilities normalised to sum to one.
Class order is alphabetical, so an arg-max tie resolves to the first class.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile import config as C
from febrile.config import JobConfig
from febrile.operators.ml_prep import FEATURES, fit_preprocessor
from febrile.session import ensure_checkpoint_dir

LABEL = "__y"
WEIGHT = "__w"
PROBS = "class_probs"
INTERCEPT = "(intercept)"
#: A gradient counts as zero up to this share of the largest that it could be.
GRADIENT_SHARE = 1e-6
#: Rows of a task of the boosted trees' jobs, at most about, up to ``BOOST_TASKS`` tasks: thousands of short jobs, whose time is that of their
#: tasks' starts.  Beyond, tasks take more rows each, up to ``BOOST_MOST_ROWS_PER_TASK``, and only then become more.
BOOST_ROWS_PER_TASK, BOOST_TASKS, BOOST_MOST_ROWS_PER_TASK = 20_000, 64, 200_000


@dataclass
class TypeModel:
    model: PipelineModel       # adds ``class_probs`` (array<double>, class order)
    classes: list[str]
    name: str

    def save(self, path: str) -> None:
        """One folder that ``load`` makes the whole model of: the pipeline, its kind and its class names in order."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(self.name, self.classes)], "name string, classes array<string>").write.mode("overwrite").json(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TypeModel:
        row = spark.read.schema("name string, classes array<string>").json(f"{path}/classes").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), list(row["classes"]), row["name"])


def fit_sample(train: DataFrame, label: str, cfg: JobConfig) -> DataFrame:
    """The rows a model is fitted on, with ``__w``, the training rows that each stands for.

    Every row up to ``max_fit_rows``.  Beyond, each class has its own share by id
    hash, from one grouped count: the common share, but at least
    ``min_fit_rows_per_class`` rows (all rows of a smaller class).  The weights give
    the classes their proportions back.
    """
    sizes = {r["c"]: r["count"] for r in train.groupBy(F.col(label).cast("string").alias("c")).count().collect()}
    common = cfg.max_fit_rows / max(sum(sizes.values()), 1)
    if common >= 1:
        return train.withColumn(WEIGHT, F.lit(1.0))
    shares = [(c, min(1.0, max(common, cfg.min_fit_rows_per_class / n))) for c, n in sizes.items()]
    table = F.broadcast(train.sparkSession.createDataFrame(shares, "__c string, __share double"))  # a row per class
    at = F.pmod(F.xxhash64(F.lit(cfg.random_state + 1), F.col(cfg.order_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = train.withColumn("__c", F.col(label).cast("string")).join(table, "__c")
    return rows.filter(at < F.col("__share")).select(*train.columns, (F.lit(1.0) / F.col("__share")).alias(WEIGHT))


def train_outbreak_model(train: DataFrame, num_cols, cat_cols, cfg: JobConfig) -> PipelineModel:
    """Preparation statistics come from all training rows, the coefficients from ``fit_sample``."""
    prep = fit_preprocessor(train, num_cols, cat_cols)
    data = prep.transform(fit_sample(train, cfg.label_outbreak, cfg)).withColumn(LABEL, F.col(cfg.label_outbreak).cast("double"))
    data = data.select(FEATURES, LABEL, WEIGHT)
    size = data.agg(F.sum(WEIGHT).alias("n"), F.count_distinct(LABEL).alias("k")).first()
    if size["k"] < 2:
        raise ValueError("the outbreak model needs training rows with and without an outbreak")
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=cfg.lr_max_iter, tol=cfg.lr_tolerance,
                            regParam=1.0 / size["n"], elasticNetParam=0.0, standardization=False, family="binomial")
    return PipelineModel(stages=[*prep.stages, lr.fit(data)])


def coefficients(model: PipelineModel, sample: DataFrame) -> list[tuple[str, float]]:
    """(feature, coefficient) of the outbreak model, the intercept last."""
    lr = model.stages[-1]
    names = feature_names(PipelineModel(stages=model.stages[:-1]).transform(sample.limit(0)))
    return [*zip(names, lr.coefficients.toArray().tolist(), strict=True), (INTERCEPT, float(lr.intercept))]


def gradient_certificate(model: PipelineModel, train: DataFrame, cfg: JobConfig) -> DataFrame:
    """feature, coefficient, gradient, bound: how close the outbreak model is to the optimum of its objective.

    The objective is the (weighted) log loss plus half the squared coefficients;
    its gradient by a coefficient is sum(w (p - y) x) plus the coefficient, and
    sum(w (p - y)) for the intercept, which is not penalised.  Both sums are one
    aggregate over the rows of the fit; at the optimum all are zero.  ``bound`` is
    ``GRADIENT_SHARE`` of sum(w |x|), the largest that the gradient could be.
    """
    rows = fit_sample(train, cfg.label_outbreak, cfg)
    scored = score_outbreak(model, rows, "__p").select(
        FEATURES, (F.col("__p") * F.col(WEIGHT)).alias("wp"), (F.col(cfg.label_outbreak).cast("double") * F.col(WEIGHT)).alias("wy"), WEIGHT)
    total = Summarizer.metrics("sum", "normL1")
    sums = scored.agg(total.summary(F.col(FEATURES), F.col("wp")).alias("p"), total.summary(F.col(FEATURES), F.col("wy")).alias("y"),
                      total.summary(F.col(FEATURES), F.col(WEIGHT)).alias("all"), F.sum("wp").alias("sp"), F.sum("wy").alias("sy"),
                      F.sum(WEIGHT).alias("n")).first()
    own = coefficients(model, train)
    size = sums["all"]["normL1"].toArray().tolist()
    out = [(name, w, float(p - y + w), GRADIENT_SHARE * max(s, 1.0)) for (name, w), p, y, s in
           zip(own[:-1], sums["p"]["sum"].toArray(), sums["y"]["sum"].toArray(), size, strict=True)]
    out.append((INTERCEPT, own[-1][1], float(sums["sp"] - sums["sy"]), GRADIENT_SHARE * sums["n"]))
    return train.sparkSession.createDataFrame(out, "feature string, coefficient double, gradient double, bound double")


def _label_indexer(train: DataFrame, label: str):
    return StringIndexer(inputCol=label, outputCol=LABEL, stringOrderType="alphabetAsc").fit(train)


def _type_data(train: DataFrame, rows: DataFrame, num_cols, cat_cols, cfg: JobConfig):
    """Preparation and class order from all training rows; features, label and weight of ``rows``."""
    prep = fit_preprocessor(train, num_cols, cat_cols)
    idx = _label_indexer(train, cfg.label_type)
    data = idx.transform(prep.transform(rows))
    return prep, idx, data.select(FEATURES, LABEL, WEIGHT)


def train_type_forest(train: DataFrame, num_cols, cat_cols, cfg: JobConfig) -> TypeModel:
    prep, idx, data = _type_data(train, fit_sample(train, cfg.label_type, cfg), num_cols, cat_cols, cfg)
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=cfg.rf_num_trees,
                                maxDepth=cfg.rf_max_depth, minInstancesPerNode=1, featureSubsetStrategy="sqrt",
                                impurity="gini", bootstrap=True, maxBins=128, seed=cfg.random_state,
                                maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
                                probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred")
    rf_model = rf.fit(data)
    return TypeModel(PipelineModel(stages=[*prep.stages, rf_model]), list(idx.labels), "RandomForest")


def _boost_tasks(rows: int) -> int:
    return max(1, min(-(-rows // BOOST_ROWS_PER_TASK), BOOST_TASKS), -(-rows // BOOST_MOST_ROWS_PER_TASK))


def train_type_boosted(train: DataFrame, num_cols, cat_cols, cfg: JobConfig) -> TypeModel:
    """One boosted-tree model per class (one-vs-rest), each fitted on all training rows; probabilities normalised.

    The trees are bounded by their depth, not by the rows, so the rows have no limit.
    Each tree bags ``gbt_subsample`` of them, which is part of the method; Spark
    itself finds the cuts that trees may take from about 10,000 of them.
    Every level of every tree is a job over the rows of the fit.  They are dealt
    by their own number, not by the partitions of the table that they come from,
    and checkpointed, so that a job's tasks neither grow with that table nor
    carry its lineage.
    """
    prep, idx, data = _type_data(train, train.withColumn(WEIGHT, F.lit(1.0)), num_cols, cat_cols, cfg)
    ensure_checkpoint_dir(train.sparkSession)
    found = data.cache()
    data = found.repartition(_boost_tasks(found.count())).checkpoint(eager=True).cache()
    found.unpersist()

    def fit_class(k: int):
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol=f"__y{k}", weightCol=WEIGHT, maxIter=cfg.gbt_rounds,
                            maxDepth=cfg.gbt_max_depth, stepSize=cfg.gbt_step, subsamplingRate=cfg.gbt_subsample,
                            featureSubsetStrategy=str(cfg.gbt_subsample), seed=cfg.random_state,
                            predictionCol=f"__pred{k}")
        gbt.setProbabilityCol(f"__prob{k}").setRawPredictionCol(f"__raw{k}")
        return gbt.fit(data.withColumn(f"__y{k}", (F.col(LABEL) == k).cast("double")))

    # the per-class models are independent: submit their jobs concurrently
    with ThreadPoolExecutor(max_workers=max(1, len(idx.labels))) as pool:
        class_models = list(pool.map(fit_class, range(len(idx.labels))))
    data.unpersist()
    stages = [*prep.stages, *class_models]
    return TypeModel(PipelineModel(stages=stages), list(idx.labels), "GradientBoosting")


def class_probabilities(model: TypeModel, df: DataFrame) -> DataFrame:
    """Transform and expose ``class_probs`` in class order."""
    out = model.model.transform(df)
    if model.name == "RandomForest":
        return out.withColumn(PROBS, vector_to_array(F.col("__prob")))
    k = len(model.classes)
    ps = [vector_to_array(F.col(f"__prob{i}"))[1] for i in range(k)]
    total = ps[0]
    for p in ps[1:]:
        total = total + p
    return out.withColumn(PROBS, F.array(*[F.when(total > 0, p / total).otherwise(F.lit(1.0 / k)) for p in ps]))


def score_outbreak(model: PipelineModel, df: DataFrame, out: str = "P_Outbreak") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1])


def arg_max_class(probs: Column, classes: list[str]) -> tuple[Column, Column]:
    """(class, probability) of the first maximum of ``probs``."""
    top = F.array_max(probs)
    pos = F.array_position(probs, top)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pos.cast("int")), top


def gate_type(df: DataFrame, p_col: str, probs_col: str, classes: list[str], threshold: float) -> DataFrame:
    """Type and its probability where P_Outbreak >= threshold, else 'None' and 0."""
    cls, top = arg_max_class(F.col(probs_col), classes)
    gate = F.col(p_col) >= F.lit(float(threshold))
    p_type = F.when(gate, top).otherwise(F.lit(0.0))
    return df.withColumns({
        "Fever_Type": F.when(gate, cls).otherwise(F.lit(C.NO_FEVER_TYPE)),
        "P_Type": p_type,
    }).withColumn("Severity_Index", F.col(p_col) * F.col("P_Type"))


def feature_names(transformed: DataFrame, col: str = FEATURES) -> list[str]:
    """Names of the assembled vector slots from the ML attribute metadata."""
    meta = transformed.schema[col].metadata.get("ml_attr", {})
    size = meta.get("num_attrs", 0)
    names = [f"f{i}" for i in range(size)]
    for group in meta.get("attrs", {}).values():
        for a in group:
            raw = a.get("name", f"f{a['idx']}")
            for prefix in ("__num_", "__ohe_"):
                raw = raw.replace(prefix, "")
            names[a["idx"]] = raw
    return names


def feature_importances(model: TypeModel, sample: DataFrame) -> DataFrame:
    """(feature, importance) of the forest, names from the vector metadata."""
    spark = sample.sparkSession
    forest = next(s for s in model.model.stages if hasattr(s, "featureImportances"))
    names = feature_names(PipelineModel(stages=model.model.stages[:-1]).transform(sample.limit(1)))
    imp = forest.featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_feature_importances(importances: DataFrame, k: int = 20) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)
