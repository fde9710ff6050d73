import os

from pyspark.sql import types as T

from conftest import SF_SMALL
from febrile.sources import fixtures as fx
from febrile.sources.store import read_store
from febrile.streaming.upload_stream import batch_folder, start_upload_stream

SCHEMA = T.StructType([
    T.StructField("row_seq", T.LongType()), T.StructField("Region", T.StringType()),
    T.StructField("feat_chars", T.DoubleType()), T.StructField("feat_spaces", T.DoubleType()),
    T.StructField("feat_lang", T.StringType()), T.StructField("outbreak_label", T.IntegerType()),
    T.StructField("fever_type", T.StringType()),
])


def test_each_upload_updates_the_store(spark, scratch):
    watch = os.path.join(scratch, "incoming")
    fx.observations(spark, SF_SMALL).coalesce(1).write.option("header", True).csv(watch)
    q = start_upload_stream(spark, watch, SCHEMA, scratch + "/store", fx.candidates(spark, SF_SMALL),
                            scratch + "/ckpt", available_now=True, clock=lambda: "t0")
    q.awaitTermination(600)
    preds = read_store(spark, batch_folder(scratch + "/store", 0), "predictions")
    n = fx.observations(spark, SF_SMALL).select("Region").distinct().count()
    assert preds.count() == n
    assert preds.filter("ts = 't0'").count() == n


def test_two_uploads_never_delete(spark, scratch):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    watch = os.path.join(scratch, "incoming2")
    obs = fx.observations(spark, sf)
    # two uploads that each hold every source (sources cycle with the document id);
    # only the first carries the 'src0' source
    first = obs.filter(F.col("row_seq") % 40 < 20)
    second = obs.filter((F.col("row_seq") % 40 >= 20) & (F.col("Region") != "src0"))
    first.coalesce(1).write.option("header", True).csv(watch + "/a")
    second.coalesce(1).write.option("header", True).csv(watch + "/b")
    times = ["t2", "t1"]
    q = start_upload_stream(spark, watch + "/*", SCHEMA, scratch + "/store", fx.candidates(spark, sf),
                            scratch + "/ckpt", available_now=True, clock=times.pop)
    q.awaitTermination(1200)
    preds = {r["region"]: r["ts"] for r in
             read_store(spark, batch_folder(scratch + "/store", 1), "predictions").collect()}
    assert set(preds) == {r[0] for r in obs.select("Region").distinct().collect()}
    assert preds["src0"] == "t1"                 # only in the first upload: kept
    assert {preds[k] for k in preds if k != "src0"} == {"t2"}
