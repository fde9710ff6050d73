from pyspark.sql import functions as F

from febrile.operators import evaluation as EV
from febrile.operators import ml_prep as MP
from febrile.plans.upload_run import run_upload
from febrile.schemas import CANDIDATES
from febrile.sources.store import empty_store

SCORED = "row_seq long, Region string, P_Outbreak double, Fever_Type string, P_Type double, Severity_Index double"


def test_empty_evaluation_inputs(spark):
    empty = spark.createDataFrame([], "y int, s double, t string, p string")
    assert EV.roc_auc(empty, "y", "s").first()[0] is None
    assert EV.roc_curve_points(empty, "y", "s").count() == 0
    assert EV.confusion_matrix(empty, "t", "p").count() == 0


def test_single_class_auc_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert EV.roc_auc(df, "y", "s").first()[0] is None


def test_split_of_empty_table(spark):
    empty = spark.createDataFrame([], "id long, y int")
    assert MP.stratified_split(empty, "y", "id").count() == 0


def test_upload_into_empty_stores_without_candidates(spark):
    none = [empty_store(spark, n) for n in ("predictions", "region_metadata", "pharma_stock")]
    scored = spark.createDataFrame([(1, "A", 0.9, "Viral", 0.5, 0.45), (2, "A", 0.2, "None", 0.0, 0.0),
                                    (3, "B", 0.1, "None", 0.0, 0.0)], SCORED)
    res = run_upload(*none, scored, spark.createDataFrame([], CANDIDATES), "t1")
    g = res.geocode_summary.first()
    assert (g["newly_geocoded"], g["cached"], g["failed"]) == (0, 0, 2)
    meta = {r["region"]: tuple(r) for r in res.region_metadata.collect()}
    assert meta == {"A": ("A", None, None, 1_000_000, "Unknown"), "B": ("B", None, None, 1_000_000, "Unknown")}
    stock = {r["region"]: r for r in res.pharma_stock.collect()}
    # A: first row severity 0.45 x 1e6 x 0.001 = 450; B: floored to 50
    assert (stock["A"]["paracetamol"], stock["A"]["ors"]) == (450, 360)
    assert (stock["B"]["paracetamol"], stock["B"]["iv_fluids"]) == (50, 15)
    preds = {r["region"]: r for r in res.predictions.collect()}
    assert preds["A"]["p_outbreak"] == 0.2 and preds["A"]["ts"] == "t1"      # last row wins
    assert sorted(r[0] for r in res.failed_regions.collect()) == ["A", "B"]
    assert res.run_summary.first()["total_rows"] == 3
    assert res.predictions.filter(F.col("region") == "C").count() == 0


def test_row_per_region_on_empty_and_all_null_strings(spark):
    from febrile.operators import upserts as U
    empty = spark.createDataFrame([], SCORED)
    assert U.last_row_per_region(empty).count() == 0
    assert U.region_batch_summary(empty).count() == 0
    nulls = spark.createDataFrame([(1, "A", 0.5, None, 0.1, 0.05), (2, "A", 0.6, None, 0.2, 0.12)], SCORED)
    r = U.last_row_per_region(nulls).first()
    assert (r["row_seq"], r["Fever_Type"], r["Severity_Index"]) == (2, None, 0.12)


def test_nan_is_never_at_risk(spark):
    from febrile.functions import rules as R
    from febrile.operators import aggregates as A
    from febrile.operators import filters as FL
    from febrile.operators import topk as K
    nan = float("nan")
    view = spark.createDataFrame(
        [("A", nan, "Viral", 0.5, nan, 10), ("B", 0.9, "Viral", 0.5, 0.45, 20), ("C", None, None, None, None, None)],
        "region string, p_outbreak double, fever_type string, p_type double, severity_index double, population long")
    k = A.gov_kpis(view).first()
    assert (k["high_risk_districts"], k["active_alerts"], k["avg_risk"], k["population_at_risk"]) == (1, 1, 0.45, 20)
    assert [r["region"] for r in FL.filter_high_risk(view).collect()] == ["B"]
    assert [r["region"] for r in FL.filter_active_alerts(view).collect()] == ["B"]
    assert [r["region"] for r in K.priority_action_plan(view).collect()] == ["B"]
    assert K.highest_risk_region(view).first()[0] == "B" and A.pharma_kpis(view).first()["highest_risk_region"] == "B"
    bands = {r["region"]: (r["m"], r["p"], r["c"]) for r in view.select(
        "region", R.map_risk_label("severity_index").alias("m"), R.public_risk_level("severity_index").alias("p"),
        R.card_fill("severity_index").alias("c")).collect()}
    assert bands["A"] == bands["C"] == ("Low", "LOW RISK", "#FEF3C7") and bands["B"][0] == "High"
    batch = spark.createDataFrame([(1, "A", nan, "Viral", 0.5, nan), (2, "B", 0.2, "None", 0.0, 0.0)], SCORED)
    assert tuple(A.run_summary(batch).first()) == (2, 0, 0.0, 0)


def test_two_partial_edits_without_order_give_one_row(spark):
    from febrile.operators import upserts as U
    from febrile.schemas import REGION_METADATA
    edits = spark.createDataFrame([("A", 1.0, None, None, None), ("A", None, 2.0, 7, None)],
                                  "region string, lat double, lon double, population long, state string")
    rows = U.merge_region_metadata(spark.createDataFrame([], REGION_METADATA), edits).collect()
    assert [tuple(r) for r in rows] == [("A", 1.0, 2.0, 7, None)]


def test_a_cluster_without_a_shared_checkpoint_folder_is_refused():
    import pytest

    from febrile.session import ensure_checkpoint_dir, is_local

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    assert is_local("local[*]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
