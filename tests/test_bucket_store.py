import os

import pytest
from pyspark.sql import functions as F

from febrile.operators import upserts as U
from febrile.plans.upload_run import run_upload, upload_in_place, upload_to
from febrile.schemas import PREDICTIONS
from febrile.sources import bucket_store as BS
from febrile.sources import fixtures as fx
from conftest import SF_SMALL


def _records(spark, names, ts, p=0.5):
    return spark.createDataFrame([(n, p, "Viral", 0.5, 0.25, ts) for n in names], PREDICTIONS)


def _files(root, name="predictions"):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/{name}") for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def store(spark, scratch):
    BS.upsert(spark, scratch, "predictions", _records(spark, [f"R{i}" for i in range(300)], "t1"), U.merge_prediction_records)
    return scratch


def test_one_region_writes_one_slot(spark, store):
    before = _files(store)
    assert len({f.split("slot=")[1].split("/")[0] for f in before}) > BS.SLOTS * 0.8
    slots = BS.upsert(spark, store, "predictions", _records(spark, ["R7"], "t2", 0.9), U.merge_prediction_records)
    after = _files(store)
    changed = {f for f in set(before) | set(after) if before.get(f) != after.get(f)}
    assert len(slots) == 1 and changed and all(f"slot={slots[0]}/" in f for f in changed)
    rows = {r["region"]: (r["p_outbreak"], r["ts"]) for r in BS.read(spark, store, "predictions").collect()}
    assert len(rows) == 300 and rows["R7"] == (0.9, "t2") and rows["R8"] == (0.5, "t1")


def test_new_regions_repeats_nulls_and_empty_batches(spark, store):
    batch = _records(spark, ["new"], "t2").union(_records(spark, ["x"], "t2").withColumn("region", F.lit(None).cast("string")))
    for _ in range(2):  # again: the same store
        BS.upsert(spark, store, "predictions", batch, U.merge_prediction_records)
        assert BS.read(spark, store, "predictions").count() == 301
    before = _files(store)
    assert BS.upsert(spark, store, "predictions", batch.limit(0), U.merge_prediction_records) == [] and _files(store) == before
    assert BS.read(spark, store, "region_metadata").count() == 0           # never written


def test_join_of_stores_needs_no_exchange(spark, store):
    from febrile.schemas import REGION_METADATA
    meta = spark.createDataFrame([(f"R{i}", 1.0, 2.0, 3, "S") for i in range(200)], REGION_METADATA)
    BS.upsert(spark, store, "region_metadata", meta, lambda old, new: U.merge_region_metadata(old, new))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = BS.read(spark, store, "predictions").join(BS.read(spark, store, "region_metadata"), "region")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert met.count() == 200


def test_a_point_read_prunes_to_one_slot(spark, store):
    one = BS.lookup(spark, store, "predictions", "R9")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r["region"] for r in one.collect()] == ["R9"]
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(region,R9)" in plan
    assert BS.lookup(spark, store, "predictions", "none").count() == 0


def test_a_new_session_sees_the_store(spark, store):
    assert BS.read(spark.newSession(), store, "predictions").count() == 300


def test_upload_in_place_gives_what_the_whole_rewrite_gives(spark, scratch):
    cand = fx.candidates(spark, SF_SMALL)
    batches = [b.limit(40).checkpoint() for b in fx.scored_batches(spark, SF_SMALL)]
    plain, store = scratch + "/s0", scratch + "/bucketed"
    for k, (batch, ts) in enumerate(zip(batches, ("t1", "t2"), strict=True)):
        upload_to(spark, plain, f"{scratch}/s{k + 1}", batch, cand, ts)
        plain = f"{scratch}/s{k + 1}"
        upload_in_place(spark, store, batch, cand, ts)
    for name in ("predictions", "region_metadata", "pharma_stock"):
        want = sorted(map(tuple, spark.read.parquet(f"{plain}/{name}").collect()), key=repr)
        assert sorted(map(tuple, BS.read(spark, store, name).collect()), key=repr) == want
    assert run_upload  # the same plan serves both
