"""Operator inputs derived from the driver's tables (whole tables, no subsets).

* observations   labelled feature rows (documents + labels)
* scored         a scored batch, many rows per region (events)
* region_metadata  per-region metadata with optional fields (customer + nation)
* pharma_stock   per-region stock (part)
* candidates     place candidates for name resolution (orders)
* metadata_edits typed-in metadata edits as text (supplier)
* evaluated      truth / prediction / score rows (documents + labels)

Every builder reads its whole source table, so each derived table grows with
the data.  Derived values use arithmetic on keys only to vary field content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import severity_index
from febrile.sources.tables import table

# Fixed fixture parameters
STOCK_TS = "2024-01-01T00:00:00+00:00"
RUN_TS = "2024-02-01T00:00:00+00:00"
BATCH_CUTOFF = "2024-01-16 00:00:00"   # events before: earlier run; after: current run
METADATA_KEY, STOCK_KEY = 3, 2         # every third region has metadata, every second one a stock record
NAN_EVERY = 31                         # every so many scored rows hold NaN
FEVER_CLASSES = ["Dengue", "Typhoid", "Viral"]


def _r(key: Column) -> Column:
    return F.concat(F.lit("R"), key.cast("string"))


def _d(x) -> Column:
    return F.lit(float(x))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    spaces = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("double")
    ftype = (F.when(F.col("lang") == "en", F.lit("Viral"))
             .when(F.col("lang").isin("de", "es"), F.lit("Dengue"))
             .otherwise(F.lit("Typhoid")))
    return j.select(
        F.col("doc_id").alias("row_seq"),
        F.col("source").alias("Region"),
        F.when(F.col("doc_id") % 19 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("n_chars").cast("double")).alias("feat_chars"),
        spaces.alias("feat_spaces"),
        F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("lang")).alias("feat_lang"),
        (F.lit(1) - F.col("quality")).cast("int").alias("outbreak_label"),
        F.when(F.col("quality") == 0, ftype).alias("fever_type"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage outputs: P_Outbreak from value, type from event kind."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    p = F.least(F.col("value") / _d(100), _d(1))
    ftype = (F.when(F.col("event_type") == "click", F.lit("Dengue"))
             .when(F.col("event_type") == "view", F.lit("Typhoid"))
             .otherwise(F.lit("Viral")))
    ptype = (F.lit(34) + F.col("event_id") % 67).cast("double") / _d(100)
    gate = F.col("P_Outbreak") >= _d(C.STAGE1_THRESHOLD)
    return (e.select(F.col("event_id").alias("row_seq"), F.col("ts").alias("event_ts"),
                     _r(F.col("user_id")).alias("Region"), p.alias("P_Outbreak"),
                     ftype.alias("_ft"), ptype.alias("_pt"))
            .select("row_seq", "event_ts", "Region", "P_Outbreak",
                    F.when(gate, F.col("_ft")).otherwise(F.lit(C.NO_FEVER_TYPE)).alias("Fever_Type"),
                    F.when(gate, F.col("_pt")).otherwise(_d(0)).alias("P_Type"),
                    F.when(gate, severity_index("P_Outbreak", "_pt")).otherwise(_d(0)).alias("Severity_Index")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).drop("event_ts")


def scored_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored batch with NaN probabilities and severities on some rows."""
    gap = F.col("row_seq") % NAN_EVERY == 0
    return scored(spark, sf_dir).withColumns({
        c: F.when(gap, F.lit(float("nan"))).otherwise(F.col(c)) for c in ("P_Outbreak", "Severity_Index")})


def scored_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(earlier batch, current batch), split at a fixed event time."""
    s = scored_events(spark, sf_dir)
    # the literal takes the column's own type (TIMESTAMP_NTZ here): no session time zone involved
    cut = F.lit(BATCH_CUTOFF).cast(s.schema["event_ts"].dataType)
    return (s.filter(F.col("event_ts") < cut).drop("event_ts"),
            s.filter(F.col("event_ts") >= cut).drop("event_ts"))


def region_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("c_custkey")
    return c.join(n, "c_nationkey").select(
        _r(k * METADATA_KEY).alias("region"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, _d(0))
         .otherwise((F.lit(8) + F.col("c_nationkey")).cast("double")).alias("lat"),
        F.when(k % 7 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(68) + F.col("c_nationkey")).cast("double")).alias("lon"),
        F.when(k % 5 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.floor((F.col("c_acctbal") + _d(1000)) * _d(500)).cast("bigint")).alias("population"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("state"),
    )


def pharma_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    size = F.col("p_size").cast("bigint")
    return p.select(_r(F.col("p_partkey") * STOCK_KEY).alias("region"),
                    (size * 10).alias("paracetamol"), (size * 8).alias("ors"),
                    (size * 6).alias("antibiotics"), (size * 3).alias("iv_fluids"),
                    F.lit(STOCK_TS).alias("last_updated"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    # candidate places are named after twice the customer key: odd-numbered
    # regions have no candidate at all, so runs also exercise failed resolution
    place = ck * 2
    prio = F.substring("o_orderpriority", 1, 1)
    state = F.when(ok % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("STATE_"), (ck % 25).cast("string")))
    district = F.when(ok % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("DIST_"), (ck % 40).cast("string")))
    return o.select(
        _r(place).alias("city"),
        (ok % 3).cast("int").alias("query_rank"),
        ok.alias("result_rank"),
        F.when(ok % 4 == 0, F.lit("elsewhere"))
         .otherwise(F.concat(F.lit("district r"), place.cast("string"), F.lit(", country"))).alias("display_name"),
        F.when(prio == "1", F.lit("city")).when(prio == "2", F.lit("village"))
         .when(prio == "3", F.lit("administrative")).when(prio == "4", F.lit("road"))
         .otherwise(F.lit("suburb")).alias("place_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit("relation")).otherwise(F.lit("node")).alias("osm_type"),
        F.when(ok % 17 == 0, F.lit("bad")).otherwise((F.lit(8) + ck % 28).cast("string")).alias("lat"),
        (F.lit(68) + ck % 28).cast("string").alias("lon"),
        F.when(ok % 9 == 0, F.lit(None).cast("double"))
         .otherwise((ok % 100).cast("double") / _d(100)).alias("importance"),
        F.create_map(F.lit("state"), state, F.lit("state_district"), district).alias("address"),
    )


def metadata_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        k.alias("edit_seq"),
        F.when(k % 9 == 8, F.lit("")).otherwise(_r(k)).alias("region"),
        F.when(k % 4 == 0, F.lit("")).when(k % 10 == 7, F.lit("abc"))
         .otherwise((F.lit(10) + nk).cast("string")).alias("lat"),
        F.when(k % 4 == 0, F.lit("")).otherwise((F.lit(70) + nk).cast("string")).alias("lon"),
        F.when(k % 3 == 0, F.lit("")).otherwise((F.lit(100000) + k).cast("string")).alias("population"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("EDITED")).alias("state"),
    )


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    k = F.col("doc_id")
    return d.join(lab, "doc_id").select(
        k.alias("row_id"), F.col("quality").alias("y_bin"),
        (((k * 37 + F.col("quality") * 20) % 101).cast("double") / _d(100)).alias("score"),
        F.col("lang").alias("y_true"),
        F.when(k % 4 == 0, F.lit("en")).otherwise(F.col("lang")).alias("y_pred"),
    )


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage outputs with a probability per fever class (ties included)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    k = F.col("event_id")
    a, b, c = (F.lit(1) + k % 3).cast("double"), (F.lit(1) + k % 5).cast("double"), (F.lit(1) + k % 2).cast("double")
    tot = a + b + c
    return e.select(k.alias("row_seq"), _r(F.col("user_id")).alias("Region"),
                    F.least(F.col("value") / _d(100), _d(1)).alias("P_Outbreak"),
                    F.array(a / tot, b / tot, c / tot).alias("class_probs"))
