"""Schemas of the scored batch, the three stores and the joined view."""

from pyspark.sql import types as T

SCORED = T.StructType([
    T.StructField("row_seq", T.LongType(), False),
    T.StructField("Region", T.StringType(), True),
    T.StructField("P_Outbreak", T.DoubleType(), True),
    T.StructField("Fever_Type", T.StringType(), True),
    T.StructField("P_Type", T.DoubleType(), True),
    T.StructField("Severity_Index", T.DoubleType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("p_outbreak", T.DoubleType(), True),
    T.StructField("fever_type", T.StringType(), True),
    T.StructField("p_type", T.DoubleType(), True),
    T.StructField("severity_index", T.DoubleType(), True),
    T.StructField("ts", T.StringType(), True),
])

REGION_METADATA = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("population", T.LongType(), True),
    T.StructField("state", T.StringType(), True),
])

PHARMA_STOCK = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("paracetamol", T.LongType(), True),
    T.StructField("ors", T.LongType(), True),
    T.StructField("antibiotics", T.LongType(), True),
    T.StructField("iv_fluids", T.LongType(), True),
    T.StructField("last_updated", T.StringType(), True),
])

STORE_SCHEMAS = {
    "predictions": PREDICTIONS,
    "region_metadata": REGION_METADATA,
    "pharma_stock": PHARMA_STOCK,
}

REGION_VIEW_COLUMNS = [
    "region", "p_outbreak", "fever_type", "p_type", "severity_index",
    "lat", "lon", "population", "state",
    "paracetamol", "ors", "antibiotics", "iv_fluids", "ts",
]

CANDIDATES = T.StructType([
    T.StructField("city", T.StringType(), True),
    T.StructField("query_rank", T.IntegerType(), True),
    T.StructField("result_rank", T.LongType(), True),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("place_type", T.StringType(), True),
    T.StructField("osm_type", T.StringType(), True),
    T.StructField("lat", T.StringType(), True),
    T.StructField("lon", T.StringType(), True),
    T.StructField("importance", T.DoubleType(), True),
    T.StructField("address", T.MapType(T.StringType(), T.StringType()), True),
])
