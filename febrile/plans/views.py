"""Store states and the joined region view built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from febrile.operators.joins import join_region_view
from febrile.operators.upserts import batch_to_predictions
from febrile.sources import fixtures as fx


def predictions(spark: SparkSession, sf_dir: str, run_ts: str = fx.RUN_TS) -> DataFrame:
    """Predictions store after one run over the whole scored batch."""
    return batch_to_predictions(fx.scored(spark, sf_dir), run_ts)


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three stores; the batch behind the predictions holds NaN rows."""
    preds = batch_to_predictions(fx.scored_with_nan(spark, sf_dir), fx.RUN_TS)
    return preds, fx.region_metadata(spark, sf_dir), fx.pharma_stock(spark, sf_dir)


def region_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_region_view(*stores(spark, sf_dir))
