"""The upload run: a scored batch updates the three stores in four set-based steps.

1. predictions: last row per region, full-outer merged into the store;
2. place resolution for regions without usable coordinates, outcome per region;
3. metadata: resolved places and 'Unknown' records merged (partial update);
4. stock: first-row severity x run population, merged into the stock store.

The scored batch is aggregated once to one row per region (partial
aggregation, a single shuffle) and checkpointed; every later step works on
region-sized tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile.operators import aggregates as A
from febrile.operators import places as P
from febrile.operators import upserts as U
from febrile.operators.filters import stamp_run_ts
from febrile.operators.joins import regions_missing_coords
from febrile.operators.stock import stock_from_first_severity
from febrile.session import ensure_checkpoint_dir
from febrile.sources import bucket_store as BS
from febrile.sources.store import read_store, write_stores


@dataclass
class UploadResult:
    predictions: DataFrame
    region_metadata: DataFrame
    pharma_stock: DataFrame
    run_summary: DataFrame
    geocode_summary: DataFrame
    failed_regions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"predictions": self.predictions, "region_metadata": self.region_metadata, "pharma_stock": self.pharma_stock}


def run_upload(predictions: DataFrame, metadata: DataFrame, stock: DataFrame, scored: DataFrame, candidates: DataFrame,
               run_ts: str, order: str = "row_seq") -> UploadResult:
    """The three stores after the run, and its summaries."""
    ensure_checkpoint_dir(scored.sparkSession)
    summary = U.region_batch_summary(scored, "Region", order).checkpoint(eager=True)
    new_preds = stamp_run_ts(summary.select(
        F.col("Region").alias("region"), F.col("P_Outbreak").alias("p_outbreak"),
        F.col("Fever_Type").alias("fever_type"), F.col("P_Type").alias("p_type"),
        F.col("Severity_Index").alias("severity_index")), run_ts)

    missing = regions_missing_coords(summary, metadata, "Region")
    # read by the outcomes and by the metadata updates: resolve once
    resolved = P.resolve_places(missing, candidates).checkpoint(eager=True)
    outcomes = P.classify_batch_regions(summary, metadata, resolved).checkpoint(eager=True)
    first = summary.select(F.col("Region").alias("region"), F.col("first_severity").alias("sev"))
    return UploadResult(
        U.merge_prediction_records(predictions, new_preds),
        U.merge_region_metadata(metadata, P.run_metadata_updates(outcomes, resolved)),
        U.upsert_pharma_stock(stock, stock_from_first_severity(first, outcomes, run_ts)),
        A.run_summary(scored), A.geocode_outcome_summary(outcomes), P.failed_regions(outcomes))


def upload_to(spark, store: str, target: str, scored: DataFrame, candidates: DataFrame, run_ts: str) -> UploadResult:
    """Read the stores below ``store``, apply the run and write them below ``target``."""
    res = run_upload(*(read_store(spark, store, n) for n in ("predictions", "region_metadata", "pharma_stock")),
                     scored, candidates, run_ts)
    write_stores(target, res.tables())
    return res


def upload_in_place(spark, root: str, scored: DataFrame, candidates: DataFrame, run_ts: str) -> UploadResult:
    """Apply the run to the bucketed stores below ``root``: only the slots of the batch's regions are read and written."""
    slots = BS.touched_slots(scored, "Region")
    res = run_upload(*(BS.part(spark, root, n, slots) for n in ("predictions", "region_metadata", "pharma_stock")),
                     scored.filter(F.col("Region").isNotNull()), candidates, run_ts)
    for name, table in res.tables().items():
        BS.replace(spark, root, name, table)
    return res


def main(argv: list[str] | None = None) -> None:
    """Batch form of the upload: score a CSV of observations and apply it to the stores."""
    import argparse
    import json
    from datetime import datetime, timezone

    from febrile.config import JobConfig
    from febrile.plans.scoring_job import run_two_stage
    from febrile.session import get_spark
    from febrile.sources.csv_scan import scan_csv_inferred

    ap = argparse.ArgumentParser(description="Score an upload and update the region stores")
    ap.add_argument("--input", required=True, help="headered CSV of observations")
    ap.add_argument("--store", required=True, help="folder of the region stores")
    ap.add_argument("--target", required=True, help="folder for the stores after the run")
    ap.add_argument("--candidates", required=True, help="parquet table of place candidates")
    ap.add_argument("--threshold", type=float, default=JobConfig().threshold)
    ap.add_argument("--use_boosting", action="store_true", help="boosted trees for the fever type")
    a = ap.parse_args(argv)
    spark = get_spark("febrile-upload")
    cfg = JobConfig(threshold=a.threshold, use_boosting=a.use_boosting)
    obs = scan_csv_inferred(spark, a.input, order_col=cfg.order_col)
    scored = run_two_stage(obs, cfg).scored
    run_ts = datetime.now(timezone.utc).isoformat()
    res = upload_to(spark, a.store, a.target, scored, spark.read.parquet(a.candidates), run_ts)
    print(json.dumps({"run": res.run_summary.first().asDict(),
                      "geocoding": res.geocode_summary.first().asDict()}))


if __name__ == "__main__":
    main()
