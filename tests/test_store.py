
from febrile.operators import upserts as U
from febrile.schemas import PHARMA_STOCK, PREDICTIONS, REGION_METADATA
from febrile.sources.store import lookup, read_store, write_stores

SCORED = "row_seq long, Region string, P_Outbreak double, Fever_Type string, P_Type double, Severity_Index double"


def test_last_and_first_row(spark):
    s = spark.createDataFrame([(1, "A", 0.9, "Viral", 0.5, 0.45), (2, "A", 0.6, "Dengue", 0.5, 0.3),
                               (3, "A", 0.8, "Typhoid", 1.0, 0.8), (4, "B", 0.1, "None", 0.0, 0.0)], SCORED)
    last = {r["Region"]: r["row_seq"] for r in U.last_row_per_region(s).collect()}
    first = {r["Region"]: r["row_seq"] for r in U.first_row_per_region(s).collect()}
    assert last == {"A": 3, "B": 4} and first == {"A": 1, "B": 4}


def test_upsert_predictions_keeps_missing_regions(spark):
    old = spark.createDataFrame([("A", 0.1, "None", 0.0, 0.0, "t0"), ("C", 0.9, "Viral", 0.5, 0.45, "t0")], PREDICTIONS)
    batch = spark.createDataFrame([(1, "A", 0.7, "Dengue", 0.5, 0.35), (2, "B", 0.2, "None", 0.0, 0.0)], SCORED)
    out = {r["region"]: r for r in U.upsert_predictions(old, batch, "t1").collect()}
    assert set(out) == {"A", "B", "C"}
    assert out["A"]["p_outbreak"] == 0.7 and out["A"]["ts"] == "t1"
    assert out["C"]["ts"] == "t0"                      # untouched (never deleted)


def test_upsert_idempotent(spark):
    old = spark.createDataFrame([("A", 0.1, "None", 0.0, 0.0, "t0")], PREDICTIONS)
    batch = spark.createDataFrame([(1, "A", 0.7, "Dengue", 0.5, 0.35), (2, "B", 0.2, "None", 0.0, 0.0)], SCORED)
    once = U.upsert_predictions(old, batch, "t1")
    twice = U.upsert_predictions(once, batch, "t1")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_merge_metadata_never_nulls_old_values(spark):
    old = spark.createDataFrame([("A", 10.0, 70.0, 5000, "S1"), ("B", None, None, None, "S2")], REGION_METADATA)
    edits = spark.createDataFrame([("A", None, None, 777, None), ("C", 1.0, 2.0, None, None)],
                                  "region string, lat double, lon double, population long, state string")
    out = {r["region"]: r for r in U.merge_region_metadata(old, edits).collect()}
    assert tuple(out["A"]) == ("A", 10.0, 70.0, 777, "S1")
    assert tuple(out["B"]) == ("B", None, None, None, "S2")
    assert tuple(out["C"]) == ("C", 1.0, 2.0, None, None)


def test_merge_metadata_ordered_edits(spark):
    old = spark.createDataFrame([("A", 10.0, 70.0, 5000, "S1")], REGION_METADATA)
    edits = spark.createDataFrame([(1, "A", 1.0, None, 1, None), (2, "A", None, 2.0, None, None),
                                   (3, "A", 3.0, None, None, "X")],
                                  "seq long, region string, lat double, lon double, population long, state string")
    r = U.merge_region_metadata(old, edits, order="seq").first()
    assert tuple(r) == ("A", 3.0, 2.0, 1, "X")


def test_stock_overwrite(spark):
    old = spark.createDataFrame([("A", 1, 1, 1, 1, "t0"), ("B", 2, 2, 2, 2, "t0")], PHARMA_STOCK)
    new = spark.createDataFrame([("A", 50, 40, 30, 15, "t1")], PHARMA_STOCK)
    out = {r["region"]: tuple(r) for r in U.upsert_pharma_stock(old, new).collect()}
    assert out == {"A": ("A", 50, 40, 30, 15, "t1"), "B": ("B", 2, 2, 2, 2, "t0")}


def test_stores_are_read_and_written_by_path(spark, scratch):
    first, second = scratch + "/first", scratch + "/second"
    assert read_store(spark, first, "predictions").count() == 0           # never written -> empty
    assert read_store(spark, first, "pharma_stock").columns == [f.name for f in PHARMA_STOCK.fields]
    write_stores(first, {"predictions": spark.createDataFrame([("A", 0.5, "Viral", 0.5, 0.25, "t1")], PREDICTIONS)})
    merged = U.upsert_predictions(read_store(spark, first, "predictions"),
                                  spark.createDataFrame([(1, "B", 0.9, "Dengue", 1.0, 0.9)], SCORED), "t2")
    write_stores(second, {"predictions": merged})
    assert sorted(r["region"] for r in read_store(spark, second, "predictions").collect()) == ["A", "B"]
    assert lookup(spark, second, "predictions", "B").first()["ts"] == "t2"
    assert lookup(spark, second, "predictions", "Z").count() == 0


def test_a_reader_sees_what_another_writer_wrote(spark, scratch):
    root = scratch + "/shared"
    assert read_store(spark, root, "predictions").count() == 0
    write_stores(root, {"predictions": spark.createDataFrame([("A", 0.5, "Viral", 0.5, 0.25, "t1")], PREDICTIONS)})
    assert read_store(spark, root, "predictions").count() == 1


def test_other_read_errors_are_not_hidden(spark, scratch):
    import os

    import pytest
    os.makedirs(scratch + "/bad")
    with open(scratch + "/bad/predictions", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        read_store(spark, scratch + "/bad", "predictions").collect()
