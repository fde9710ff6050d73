"""Plan checks: no Python UDFs, no cartesian products, pushdown into scans."""

import pytest

from conftest import SF_SMALL
from febrile.plans import catalog

QUERIES = catalog.all_queries()
#: These fit models, so building the query runs many jobs.
TRAIN = {"train_outbreak_model", "train_type_forest", "train_type_boosted", "score_outbreak", "run_two_stage_scoring",
         "feature_importances", "top20_feature_importances", "save_model", "write_metrics"}
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAIN))
def test_no_udf_no_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_lookup_pushes_key_filter(spark, scratch):
    from febrile.sources import fixtures as fx
    from febrile.sources.store import lookup, write_stores
    write_stores(scratch + "/store", {"region_metadata": fx.region_metadata(spark, SF_SMALL)})
    plan = _plan(lookup(spark, scratch + "/store", "region_metadata", "R6"))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(region,R6)" in pushed


def test_scan_prunes_columns(spark):
    from febrile.sources import fixtures as fx
    plan = _plan(fx.scored(spark, SF_SMALL))
    # events has a props column that the scored batch never reads
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_take_ordered(spark):
    plan = _plan(QUERIES["stock_top6"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_candidate_picks_combine_before_shuffle(spark):
    plan = _plan(QUERIES["resolve_places"](spark, SF_SMALL))
    assert "partial_min_by" in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["last_row_per_region", "first_row_per_region", "upsert_predictions", "scan_predictions",
                                  "size_run_stock", "resolve_places", "confusion_matrix", "join_region_view"])
def test_building_a_plan_starts_no_job(spark, name):
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    QUERIES[name](spark, SF_SMALL)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a Parquet schema is the only job that a plan needs
    assert all(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) == 1 for j in jobs) and len(jobs) <= 14


@pytest.mark.parametrize("name", ["last_row_per_region", "first_row_per_region", "gov_kpis", "pharma_kpis",
                                  "state_summary", "size_run_stock", "classification_report", "confusion_matrix"])
def test_partial_aggregation_before_shuffle(spark, name):
    """A key holding a third of the rows is combined map-side before any exchange."""
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "partial_" in plan, name


def test_hot_region_reduced_map_side(spark):
    from febrile.operators.upserts import region_batch_summary
    rows = [(i, "HOT" if i % 3 == 0 else f"R{i}", 0.5, "Viral", 0.5, 0.25) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_seq long, Region string, P_Outbreak double, Fever_Type string, "
                                     "P_Type double, Severity_Index double").repartition(6)
    out = region_batch_summary(df)
    plan = _plan(out)
    head, _, tail = plan.partition("Exchange hashpartitioning(Region")
    assert "partial_max_by" in tail and "partial_min_by" in tail     # below the exchange = map side
    hot = out.filter("Region = 'HOT'").first()
    assert hot["first_severity"] == 0.25 and out.count() == 2001


def test_region_tables_not_broadcast_by_hint(spark):
    """Region-keyed joins carry no broadcast hint: AQE decides from measured sizes."""
    import inspect

    from febrile.operators import joins, places, stock, upserts
    for mod in (joins, places, stock, upserts):
        assert "F.broadcast(" not in inspect.getsource(mod)
