from pyspark.sql import functions as F

from conftest import SF_SMALL
from febrile.plans.upload_run import run_upload, upload_to
from febrile.sources import fixtures as fx
from febrile.sources.store import read_store, write_stores


def test_upload_run_updates_all_stores(spark, scratch):
    before, after, again = scratch + "/before", scratch + "/after", scratch + "/again"
    meta0, stock0 = fx.region_metadata(spark, SF_SMALL), fx.pharma_stock(spark, SF_SMALL)
    write_stores(before, {"region_metadata": meta0, "pharma_stock": stock0})
    scored, candidates = fx.scored(spark, SF_SMALL), fx.candidates(spark, SF_SMALL)
    res = upload_to(spark, before, after, scored, candidates, fx.RUN_TS)
    preds = read_store(spark, after, "predictions")
    n_regions = scored.select("Region").distinct().count()
    assert preds.count() == n_regions
    g = res.geocode_summary.first()
    assert g["newly_geocoded"] + g["cached"] + g["failed"] == n_regions
    assert g["newly_geocoded"] and g["cached"] and g["failed"] == res.failed_regions.count() > 0
    # every batch region has a stock record stamped with the run time
    stock = read_store(spark, after, "pharma_stock")
    assert stock.join(preds.select("region"), "region", "left_semi").filter(
        F.col("last_updated") != fx.RUN_TS).count() == 0
    # regions outside the batch keep their stock (never deleted)
    assert stock.count() >= stock0.count()
    # a second identical run changes nothing (idempotent upserts)
    upload_to(spark, after, again, scored, candidates, fx.RUN_TS)
    for name in ("predictions", "region_metadata", "pharma_stock"):
        assert read_store(spark, again, name).exceptAll(read_store(spark, after, name)).count() == 0


def test_upload_reads_the_batch_once(spark):
    """Resolution and outcomes come from written tables, not from the batch again."""
    from febrile.sources.store import empty_store
    res = run_upload(*(empty_store(spark, n) for n in ("predictions", "region_metadata", "pharma_stock")),
                     fx.scored(spark, SF_SMALL), fx.candidates(spark, SF_SMALL), fx.RUN_TS)
    for df in res.tables().values():
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
