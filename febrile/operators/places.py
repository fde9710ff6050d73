"""Place-name resolution against a candidate table.

For each city and query form, a candidate must contain the city name
(case-insensitive); among all that do, the first of a preferred place kind
wins, else the first; a later query form is used only when the earlier one
gives no pick or its pick has unparsable coordinates.  Both picks are
``min_by`` aggregates that combine before the shuffle, so a hot city costs one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile import config as C
from febrile.functions.rules import estimate_population, extract_state, usable_coords
from febrile.operators.joins import distinct_regions, regions_missing_coords
from febrile.operators.upserts import merge_region_metadata


def resolve_places(cities: DataFrame, candidates: DataFrame, key: str = "region") -> DataFrame:
    """(region, lat, lon, state, population, place_type, query_rank, result_rank) per resolved city."""
    wanted = distinct_regions(cities, key).withColumnRenamed("region", "city")
    cand = candidates.join(wanted, "city", "left_semi")
    matched = cand.filter(F.contains(F.lower(F.col("display_name")), F.lower(F.col("city"))))
    preferred = (F.col("place_type").isin(*C.PREFERRED_PLACE_TYPES) |
                 (F.col("osm_type") == F.lit(C.PREFERRED_OSM_TYPE)))
    pick_cols = ["result_rank", "place_type", "lat", "lon", "importance", "address"]
    per_query = (matched.groupBy("city", "query_rank")
                 .agg(F.min_by(F.struct(*pick_cols), F.struct((~preferred).alias("p"), F.col("result_rank")))
                      .alias("pick"))
                 .select("city", "query_rank", "pick.*"))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    # a pick counts only when both coordinates parse as numbers (text 'nan' parses, as a float does)
    valid = per_query.filter(lat.isNotNull() & lon.isNotNull())
    out_cols = ["query_rank", "result_rank", "place_type", "lat", "lon", "importance", "address"]
    best = (valid.groupBy("city").agg(F.min_by(F.struct(*out_cols), F.col("query_rank")).alias("b"))
            .select("city", "b.*"))
    return best.select(
        F.col("city").alias("region"),
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"),
        extract_state("address").alias("state"),
        estimate_population("place_type", "importance").alias("population"),
        "place_type", "query_rank", "result_rank")


def classify_batch_regions(batch_regions: DataFrame, metadata: DataFrame, resolved: DataFrame,
                           key: str = "Region") -> DataFrame:
    """(region, outcome, population) for every distinct region of a run.

    cached: metadata with usable coordinates (population or the default);
    resolved: a candidate was picked (estimated population); failed: default.
    """
    regions = distinct_regions(batch_regions, key)
    cached = (metadata.filter(usable_coords("lat", "lon"))
              .select("region", F.col("population").alias("_meta_pop"), F.lit(True).alias("_cached")))
    res = resolved.select("region", F.col("population").alias("_res_pop"), F.lit(True).alias("_resolved"))
    j = regions.join(cached, "region", "left").join(res, "region", "left")
    outcome = (F.when(F.col("_cached"), F.lit("cached"))
               .when(F.col("_resolved"), F.lit("resolved"))
               .otherwise(F.lit("failed")))
    dflt = F.lit(C.DEFAULT_POPULATION).cast("bigint")
    pop = (F.when(F.col("_cached"), F.coalesce(F.col("_meta_pop"), dflt))
           .when(F.col("_resolved"), F.col("_res_pop")).otherwise(dflt))
    return j.select("region", outcome.alias("outcome"), pop.alias("population"))


def failed_regions(outcomes: DataFrame) -> DataFrame:
    """Names of the regions without coordinates after the run."""
    return outcomes.filter(F.col("outcome") == "failed").select("region")


def run_metadata_updates(outcomes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Metadata edits produced by a run: resolved places and 'Unknown' records."""
    hits = (outcomes.filter(F.col("outcome") == "resolved").select("region")
            .join(resolved.select("region", "lat", "lon", "population", "state"), "region"))
    unknown = register_unresolved_region(outcomes.filter(F.col("outcome") == "failed"))
    return hits.unionByName(unknown)


def register_unresolved_region(failed: DataFrame) -> DataFrame:
    """Unresolved places: state 'Unknown', default population, coordinates untouched."""
    return failed.select("region", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
                         F.lit(C.DEFAULT_POPULATION).cast("bigint").alias("population"),
                         F.lit(C.UNKNOWN_STATE).alias("state"))


def regeocode_missing(predictions: DataFrame, metadata: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retry resolution for predicted regions without usable coordinates.

    Returns (new metadata, one-row report of hits and total).  No stock change
    and no 'Unknown' record on this path.
    """
    missing = regions_missing_coords(predictions, metadata)
    resolved = resolve_places(missing, candidates)
    new_meta = merge_region_metadata(metadata, resolved.select("region", "lat", "lon", "population", "state"))
    report = (missing.join(resolved.select("region", F.lit(1).alias("_hit")), "region", "left")
              .agg(F.count("_hit").alias("resolved"), F.count(F.lit(1)).alias("total")))
    return new_meta, report

