"""Sorted lists and top-k.  A limit after a global sort plans as
TakeOrderedAndProject (per-partition top-k, then a merge of k rows each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import nan_to_null, priority_badge, priority_color
from febrile.operators.filters import filter_high_risk


def priority_action_plan(view: DataFrame) -> DataFrame:
    """High-risk regions by severity (desc), with badge; population stays null when unknown."""
    return (filter_high_risk(view)
            .select("region", "severity_index",
                    priority_badge("severity_index").alias("badge"),
                    priority_color("severity_index").alias("badge_color"),
                    "fever_type", "p_outbreak", "population")
            .orderBy(F.col("severity_index").desc(), F.col("region")))


def stock_top6(view: DataFrame, k: int = 6) -> DataFrame:
    return view.orderBy(nan_to_null("severity_index").desc_nulls_last(), F.col("region")).limit(k)


def highest_risk_region(view: DataFrame) -> DataFrame:
    """Region with the largest p_outbreak (ties -> smallest region); 'N/A' if empty."""
    p = nan_to_null("p_outbreak")
    best = F.min(F.when(p.isNotNull(), F.struct((-p).alias("p"), F.col("region"))))
    return view.agg(F.coalesce(best.getField("region"), F.lit(C.NOT_AVAILABLE)).alias("highest_risk_region"))


def public_high_risk_3(view: DataFrame, k: int = 3) -> DataFrame:
    return filter_high_risk(view).select("region").orderBy("region").limit(k)
