"""Set-based merge upserts for the region-keyed stores.

All three are one full outer join on ``region`` (both sides hold one row per
region), so regions missing from a batch keep their old record.  The batch
side is reduced to one row per region first with ``min_by``/``max_by``,
which aggregate partially before the shuffle: a region holding a third of
all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from febrile.operators.filters import rename_scored_columns, stamp_run_ts

_NEW = "__in_batch"


def _row_per_key(df: DataFrame, key: str, order: str, pick) -> DataFrame:
    """The whole row of each key at the extreme ``order`` (unique per key); one partial row per key and task is shuffled."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(pick(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*[F.col(c) if c == key else F.col("__row").getField(c).alias(c) for c in df.columns])


def last_row_per_region(df: DataFrame, key: str = "Region", order: str = "row_seq") -> DataFrame:
    """Last row (highest ``order``) of each key."""
    return _row_per_key(df, key, order, F.max_by)


def first_row_per_region(df: DataFrame, key: str = "Region", order: str = "row_seq") -> DataFrame:
    """First row (lowest ``order``) of each key."""
    return _row_per_key(df, key, order, F.min_by)


def region_batch_summary(scored: DataFrame, key: str = "Region", order: str = "row_seq") -> DataFrame:
    """One pass, one shuffle: per region the last row (store record) and the
    first row's severity (stock sizing)."""
    fields = ["P_Outbreak", "Fever_Type", "P_Type", "Severity_Index"]
    picked = scored.groupBy(F.col(key).alias("Region")).agg(
        F.max_by(F.struct(*fields), F.col(order)).alias("__last"),
        F.min_by(F.col("Severity_Index"), F.col(order)).alias("first_severity"))
    return picked.select("Region", *[F.col("__last").getField(c).alias(c) for c in fields], "first_severity")


def _merge(old: DataFrame, new: DataFrame, cols: list[str], take) -> DataFrame:
    o, n = old.alias("o"), new.withColumn(_NEW, F.lit(True)).alias("n")
    joined = o.join(n, F.col("o.region") == F.col("n.region"), "full_outer")
    in_batch = F.coalesce(F.col(f"n.{_NEW}"), F.lit(False))
    out = [F.coalesce(F.col("n.region"), F.col("o.region")).alias("region")]
    out += [take(in_batch, F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols]
    return joined.select(*out)


def _overwrite(in_batch: Column, new: Column, old: Column) -> Column:
    return F.when(in_batch, new).otherwise(old)


def _fill(in_batch: Column, new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def batch_to_predictions(scored: DataFrame, run_ts: str, order: str = "row_seq") -> DataFrame:
    """Scored rows -> one store record per region (the last row wins)."""
    last = last_row_per_region(scored.select(order, "Region", "P_Outbreak", "Fever_Type",
                                             "P_Type", "Severity_Index"), "Region", order)
    return stamp_run_ts(rename_scored_columns(last).drop(order), run_ts)


def merge_prediction_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Store records (one per region) replace the old record of their region."""
    return _merge(old, new, ["p_outbreak", "fever_type", "p_type", "severity_index", "ts"], _overwrite)


def upsert_predictions(old: DataFrame, scored: DataFrame, run_ts: str, order: str = "row_seq") -> DataFrame:
    return merge_prediction_records(old, batch_to_predictions(scored, run_ts, order))


def collapse_edits(edits: DataFrame, order: str | None = None) -> DataFrame:
    """Several partial edits of one region -> one row: the last non-null value
    per field, or the largest one where no ``order`` is given."""
    fields = ["lat", "lon", "population", "state"]
    if order is None:
        return edits.groupBy("region").agg(*[F.max(c).alias(c) for c in fields])
    seq = F.col(order)
    return edits.groupBy("region").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in fields])


def merge_region_metadata(old: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Partial update: only non-null incoming fields overwrite."""
    return _merge(old, collapse_edits(edits, order), ["lat", "lon", "population", "state"], _fill)


def upsert_pharma_stock(old: DataFrame, new: DataFrame) -> DataFrame:
    """The four counts and the timestamp are replaced for every region in the batch."""
    cols = ["paracetamol", "ors", "antibiotics", "iv_fluids", "last_updated"]
    return _merge(old, new.select("region", *cols), cols, _overwrite)
