"""The three dashboard screens as DataFrame plans over one joined view.

A refresh builds the joined region view once, checkpoints it into the
shared checkpoint folder (one row per region) and derives every card, list
and table of the government, pharmacy and public screens from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile.functions import rules as R
from febrile.operators import aggregates as A
from febrile.operators import joins as J
from febrile.operators import stock as S
from febrile.operators import topk as K
from febrile.operators.filters import filter_mappable
from febrile.session import ensure_checkpoint_dir


def map_table(view: DataFrame) -> DataFrame:
    """Mappable regions with band, colour and circle geometry (the map layer's data)."""
    s = "severity_index"
    return filter_mappable(view).select(
        "region", "lat", "lon", "population", "state", "fever_type", "p_outbreak", s,
        R.map_risk_label(s).alias("risk_label"), R.map_risk_color(s).alias("risk_color"),
        R.map_opacity(s).alias("opacity"), R.map_fill_opacity(s).alias("fill_opacity"),
        R.map_radius_m(s, "population").alias("radius_m"))


def government(view: DataFrame) -> dict[str, DataFrame]:
    return {"kpis": A.gov_kpis(view), "map": map_table(view),
            "priority": K.priority_action_plan(view), "states": A.state_summary(view)}


def pharmacy(view: DataFrame) -> dict[str, DataFrame]:
    return {"kpis": A.pharma_kpis(view), "demand": S.demand_by_drug(view),
            "recommendations": S.recommend_stock(view)}


def public_search(predictions: DataFrame, metadata: DataFrame, stock: DataFrame, city: str) -> DataFrame:
    """The searched city's record with its public band and advice (empty if not predicted)."""
    s = "severity_index"
    rec = J.lookup_city(predictions, metadata, stock, city)
    return rec.select("region", s, "fever_type", "p_outbreak", "population", "state",
                      R.public_risk_level(s).alias("risk_level"), R.public_risk_color(s).alias("risk_color"),
                      R.public_risk_bg(s).alias("risk_bg"), R.public_advice(s).alias("advice"))


def public(view: DataFrame) -> dict[str, DataFrame]:
    return {"high_risk_areas": K.public_high_risk_3(view)}


def refresh(predictions: DataFrame, metadata: DataFrame, stock: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """All screens from one materialised view of the given stores."""
    ensure_checkpoint_dir(predictions.sparkSession)
    view = J.join_region_view(predictions, metadata, stock).checkpoint(eager=True)
    return {"government": government(view), "pharmacy": pharmacy(view), "public": public(view)}


def with_display_text(kpis: DataFrame) -> DataFrame:
    """Government KPI row with its display strings."""
    return kpis.select("*", F.concat(F.col("high_risk_districts").cast("string"), F.lit("/"),
                                     F.col("total_districts").cast("string")).alias("high_risk_text"),
                       F.col("active_alerts").cast("string").alias("active_alerts_text"),
                       R.fmt_fixed("avg_risk", 2).alias("avg_risk_text"),
                       R.fmt_fixed("avg_risk", 3).alias("avg_risk_3_text"),
                       R.fmt_pct("avg_risk", 1).alias("avg_risk_pct_text"),
                       R.fmt_thousands("population_at_risk").alias("population_at_risk_text"))
