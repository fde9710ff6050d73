"""Stock sizing and demand.

Two different rules exist on purpose: the run-time rule floors the base and
derives the other drugs from it; the view recommendation derives from the
unfloored base and floors every drug separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import card_border, card_fill, nan_to_null, safe_float, trunc_long
from febrile.operators.aggregates import demand_index
from febrile.operators.topk import stock_top6
from febrile.operators.upserts import first_row_per_region, upsert_pharma_stock

_POP = float(C.DEFAULT_POPULATION)


def _base(pop, sev):
    return trunc_long(F.coalesce(nan_to_null(pop * sev * F.lit(C.STOCK_BASE_FACTOR)), F.lit(0.0)))


def stock_from_first_severity(first: DataFrame, populations: DataFrame, run_ts: str) -> DataFrame:
    """Run-time rule on (region, sev): base = max(50, int(pop x sev x 0.001)), then derived."""
    base = F.greatest(F.lit(C.RUN_STOCK_BASE_FLOOR).cast("bigint"),
                      _base(F.col("population").cast("double"), F.col("sev")))
    return (first.join(populations.select("region", "population"), "region", "left")
            .withColumn("population", F.coalesce(F.col("population"), F.lit(C.DEFAULT_POPULATION).cast("bigint")))
            .select("region", base.alias("paracetamol"))
            .select("region", "paracetamol",
                    *[trunc_long(F.col("paracetamol") * F.lit(share)).alias(name)
                      for name, share in C.RUN_STOCK_SHARES.items()],
                    F.lit(run_ts).alias("last_updated")))


def size_run_stock(scored: DataFrame, populations: DataFrame, run_ts: str,
                   order: str = "row_seq") -> DataFrame:
    """Per region of the batch: the first row's severity and the run population.

    ``populations`` holds (region, population) for every region of the batch.
    """
    first = (first_row_per_region(scored.select(order, "Region", "Severity_Index"), "Region", order)
             .select(F.col("Region").alias("region"), F.col("Severity_Index").alias("sev")))
    return stock_from_first_severity(first, populations, run_ts)


def recommend_stock(view: DataFrame, k: int = 6) -> DataFrame:
    """Quantities for the k most severe regions with the per-drug floors."""
    top = stock_top6(view, k)
    pop = safe_float(F.col("population"), _POP)
    sev = safe_float(F.col("severity_index"), 0.0)
    floors = C.VIEW_STOCK_FLOORS
    return (top.select("region", sev.alias("severity"), _base(pop, sev).alias("base"))
            .select("region", "severity",
                    F.greatest(F.lit(floors["paracetamol"]).cast("bigint"), F.col("base")).alias("paracetamol"),
                    *[F.greatest(F.lit(floors[name]).cast("bigint"), trunc_long(F.col("base") * F.lit(share)))
                      .alias(name) for name, share in C.RUN_STOCK_SHARES.items()],
                    card_fill("severity").alias("card_color"),
                    card_border("severity").alias("border_color")))


def demand_by_drug(view: DataFrame) -> DataFrame:
    """Four rows: units per drug = trunc(total demand x share / 100,000)."""
    shares = F.array(*[F.struct(F.lit(d).alias("drug"), F.lit(s).alias("share")) for d, s in C.DEMAND_SHARES])
    total = view.agg(F.coalesce(F.sum(demand_index(view)), F.lit(0.0)).alias("total"))
    return (total.select("total", F.explode(shares).alias("d"))
            .select(F.col("d.drug").alias("drug"), F.col("d.share").alias("share"),
                    trunc_long(F.col("total") * F.col("d.share") / F.lit(float(C.DEMAND_DIVISOR))).alias("required")))


def dispatch_orders(view: DataFrame, stock: DataFrame, chosen: DataFrame, run_ts: str) -> DataFrame:
    """Write the recommended quantities of the chosen regions to the stock store."""
    rec = recommend_stock(view).join(chosen.select("region").distinct(), "region", "left_semi")
    new = rec.select("region", "paracetamol", "ors", "antibiotics", "iv_fluids", F.lit(run_ts).alias("last_updated"))
    return upsert_pharma_stock(stock, new)
