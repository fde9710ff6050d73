"""Projections, filters and row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import at_least, nan_to_null

SCORED_TO_STORE = {"Region": "region", "P_Outbreak": "p_outbreak", "Fever_Type": "fever_type",
                   "P_Type": "p_type", "Severity_Index": "severity_index"}


def project_features(df: DataFrame, key: str, num_cols: list[str], cat_cols: list[str],
                     keep: list[str] | None = None) -> DataFrame:
    """Key and feature columns only (the key sits next to its features, no join)."""
    return df.select(*(keep or []), key, *num_cols, *cat_cols)


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label]).withColumn(label, F.col(label).cast("int"))


def filter_high_risk(df: DataFrame, col: str = "severity_index") -> DataFrame:
    return df.filter(at_least(col, C.HIGH_RISK_SEVERITY))


def filter_active_alerts(df: DataFrame, col: str = "p_outbreak") -> DataFrame:
    return df.filter(at_least(col, C.ALERT_P_OUTBREAK))


def filter_mappable(df: DataFrame) -> DataFrame:
    """Rows with both coordinates non-null (0.0 is a valid map point here)."""
    return df.dropna(subset=["lat", "lon"])


def rename_scored_columns(scored: DataFrame) -> DataFrame:
    return scored.withColumnsRenamed(SCORED_TO_STORE)


def stamp_run_ts(df: DataFrame, run_ts: str, col: str = "ts") -> DataFrame:
    """Attach the run time; passed in as a parameter so reruns are deterministic."""
    return df.withColumn(col, F.lit(run_ts))


def nan_as_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in cols})


def validate_metadata_edits(edits: DataFrame) -> DataFrame:
    """Text edits -> typed rows with a rejection reason (null when valid).

    Blank fields mean "no change" (null); a region is required; a number that
    does not parse rejects the whole edit.
    """
    def blank_null(c):
        return F.nullif(F.col(c), F.lit(""))

    lat, lon, pop = blank_null("lat"), blank_null("lon"), blank_null("population")
    lat_d, lon_d, pop_l = lat.try_cast("double"), lon.try_cast("double"), pop.try_cast("bigint")
    reason = (F.when(F.coalesce(F.col("region"), F.lit("")) == "", F.lit("no region given"))
              .when(lat.isNotNull() & lat_d.isNull(), F.lit("lat is no number"))
              .when(lon.isNotNull() & lon_d.isNull(), F.lit("lon is no number"))
              .when(pop.isNotNull() & pop_l.isNull(), F.lit("population is no whole number")))
    extra = [c for c in edits.columns if c not in ("region", "lat", "lon", "population", "state")]
    return edits.select(*extra, F.col("region"), lat_d.alias("lat"), lon_d.alias("lon"),
                        pop_l.alias("population"), blank_null("state").alias("state"),
                        reason.alias("reject_reason"))


def select_stage2_training_rows(df: DataFrame, label_outbreak: str, label_type: str,
                                preferred_min: int = C.STAGE2_PREFERRED_MIN_ROWS,
                                minimum: int = C.STAGE2_MIN_ROWS) -> tuple[DataFrame, str]:
    """Rows for the type model and which rule chose them.

    Prefer positive rows with a known type; below ``preferred_min`` fall back
    to every row with a known type; below ``minimum`` fail.  One aggregate job
    computes all three counts.
    """
    lo, lt = F.col(label_outbreak), F.col(label_type)
    counts = df.agg(F.count(lo).alias("n_label"),
                    F.count_if((lo == 1) & lt.isNotNull()).alias("n_pos_typed"),
                    F.count_if(lt.isNotNull()).alias("n_typed")).first()
    if counts["n_label"] > 0 and counts["n_pos_typed"] >= preferred_min:
        return df.filter((lo == 1) & lt.isNotNull()), "positive"
    if counts["n_typed"] < minimum:
        raise ValueError(f"the type model needs {minimum} rows with a known type; there are {counts['n_typed']}")
    return df.filter(lt.isNotNull()), ("fallback_all_typed" if counts["n_label"] > 0 else "all_typed")
