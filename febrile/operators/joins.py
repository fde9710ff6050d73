"""Key joins over the stores.

Every join is an equi join on ``region`` between tables that hold at most one
row per region; Catalyst/AQE chooses broadcast or sort-merge from measured
sizes, so no side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import usable_coords
from febrile.operators.filters import nan_as_null
from febrile.schemas import REGION_VIEW_COLUMNS



def join_region_view(predictions: DataFrame, metadata: DataFrame, stock: DataFrame) -> DataFrame:
    """predictions LEFT metadata LEFT stock; absent prediction fields get their
    defaults, NaN ones become null (neither is ever at risk)."""
    p = predictions.select("region", *[F.coalesce(F.col(c), F.lit(v)).alias(c)
                                       for c, v in C.VIEW_PREDICTION_DEFAULTS.items()])
    p = nan_as_null(p, [c for c, v in C.VIEW_PREDICTION_DEFAULTS.items() if isinstance(v, float)])
    m = metadata.select("region", "lat", "lon", "population", "state")
    s = stock.select("region", "paracetamol", "ors", "antibiotics", "iv_fluids")
    return p.join(m, "region", "left").join(s, "region", "left").select(*REGION_VIEW_COLUMNS)


def lookup_city(predictions: DataFrame, metadata: DataFrame, stock: DataFrame, city: str) -> DataFrame:
    """The joined record of one region (exact, case-sensitive key); empty if not predicted."""
    key = F.lit(city)
    return join_region_view(predictions.filter(F.col("region") == key),
                            metadata.filter(F.col("region") == key),
                            stock.filter(F.col("region") == key))


def lookup_region_metadata(metadata: DataFrame, region: str) -> DataFrame:
    return metadata.filter(F.col("region") == F.lit(region))


def distinct_regions(df: DataFrame, key: str = "region") -> DataFrame:
    return df.select(F.col(key).alias("region")).distinct()


def _usable_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.filter(usable_coords("lat", "lon")).select("region")


def regions_missing_coords(regions: DataFrame, metadata: DataFrame, key: str = "region") -> DataFrame:
    """Distinct regions without usable coordinates (absent, null or zero)."""
    return distinct_regions(regions, key).join(_usable_metadata(metadata), "region", "left_anti")


def regions_with_cached_coords(regions: DataFrame, metadata: DataFrame, key: str = "region") -> DataFrame:
    return distinct_regions(regions, key).join(_usable_metadata(metadata), "region", "left_semi")
