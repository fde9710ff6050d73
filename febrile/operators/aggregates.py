"""Single-pass aggregates behind the KPI cards and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import at_least, nan_to_null


def _high():
    return at_least("severity_index", C.HIGH_RISK_SEVERITY)


def gov_kpis(view: DataFrame) -> DataFrame:
    """High-risk count, total, alerts, mean severity and population at risk.

    Population at risk sums the known populations of high-risk rows; only when
    no row of the table has a population it is estimated as rows x 1,000,000.
    """
    n_high = F.count_if(_high())
    return view.agg(
        n_high.alias("high_risk_districts"),
        F.count(F.lit(1)).alias("total_districts"),
        F.count_if(at_least("p_outbreak", C.ALERT_P_OUTBREAK)).alias("active_alerts"),
        F.coalesce(F.avg(nan_to_null("severity_index")), F.lit(0.0)).alias("avg_risk"),
        F.when(F.count("population") == 0, n_high * F.lit(C.DEFAULT_POPULATION))
         .otherwise(F.coalesce(F.sum(F.when(_high(), F.col("population"))), F.lit(0)))
         .cast("bigint").alias("population_at_risk"),
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Row count (not distinct regions), high-risk rows, mean severity, alert rows."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(at_least("Severity_Index", C.HIGH_RISK_SEVERITY)).alias("high_risk_rows"),
        F.avg(nan_to_null("Severity_Index")).alias("avg_severity"),
        F.count_if(at_least("P_Outbreak", C.ALERT_P_OUTBREAK)).alias("alert_rows"),
    )


def state_summary(view: DataFrame) -> DataFrame:
    """Districts per known state, sorted by state."""
    return (view.filter(F.col("state").isNotNull())
                .groupBy("state").agg(F.count(F.lit(1)).alias("districts"))
                .orderBy("state"))


def top_fever_type(view: DataFrame) -> DataFrame:
    """Most frequent fever type (nulls skipped, ties -> smallest); 'N/A' if none."""
    counts = view.filter(F.col("fever_type").isNotNull()).groupBy("fever_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.min_by("fever_type", F.struct(-F.col("n"), F.col("fever_type"))),
                                 F.lit(C.NOT_AVAILABLE)).alias("top_fever_type"))


def total_stock_units(view: DataFrame) -> DataFrame:
    return view.agg((F.count(F.lit(1)) * F.lit(C.STOCK_UNITS_PER_ROW)).cast("bigint").alias("total_stock_units"))


def demand_index(view: DataFrame):
    return nan_to_null("severity_index") * F.coalesce(F.col("population").cast("double"), F.lit(float(C.DEFAULT_POPULATION)))


def total_demand(view: DataFrame) -> DataFrame:
    return view.agg(F.coalesce(F.sum(demand_index(view)), F.lit(0.0)).alias("total_demand"))


def pharma_kpis(view: DataFrame) -> DataFrame:
    """Total units, top fever type, highest-risk region and fulfilment in one pass.

    Level 1 groups by fever type (partial aggregation; one row per type),
    level 2 folds those rows.  Highest risk: max p_outbreak, ties -> smallest region.
    """
    p = nan_to_null("p_outbreak")
    best = F.when(p.isNotNull(), F.struct((-p).alias("p"), F.col("region")))
    per_type = view.groupBy("fever_type").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    typed = F.col("fever_type").isNotNull()
    return per_type.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) * F.lit(C.STOCK_UNITS_PER_ROW)).cast("bigint").alias("total_stock_units"),
        F.coalesce(F.min_by(F.when(typed, F.col("fever_type")),
                            F.when(typed, F.struct(-F.col("n"), F.col("fever_type")))),
                   F.lit(C.NOT_AVAILABLE)).alias("top_fever_type"),
        F.coalesce(F.min("best").getField("region"), F.lit(C.NOT_AVAILABLE)).alias("highest_risk_region"),
        F.lit(C.STOCK_FULFILMENT_PCT).alias("stock_fulfilment_pct"),
    )


def geocode_outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of newly resolved, cached and failed regions (one row)."""
    o = F.col("outcome")
    return outcomes.agg(F.count_if(o == "resolved").alias("newly_geocoded"),
                        F.count_if(o == "cached").alias("cached"),
                        F.count_if(o == "failed").alias("failed"))
