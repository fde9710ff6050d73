"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads whole driver tables (through ``febrile.sources.fixtures``)
and runs the library operator on them.  Double aggregates (sums, means) are
rounded to six places in the output, because their last bits depend on
summation order; row-level doubles are left exact (both engines compute the
same IEEE operations, and rounding would only add half-way disagreements).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.functions import rules as R
from febrile.operators import aggregates as A
from febrile.operators import filters as FL
from febrile.operators import joins as J
from febrile.operators import places as P
from febrile.operators import stock as S
from febrile.operators import topk as K
from febrile.operators import upserts as U
from febrile.plans import views as V
from febrile.session import scratch_path
from febrile.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
LOOKUP_CITY = "R6"          # the typed-in city of the public search
DISPATCH_TS = "2024-02-02T00:00:00+00:00"


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---------------------------------------------------------------- sources
def q_scan_predictions(spark, d):
    return V.predictions(spark, d)


def q_lookup_region_metadata(spark, d):
    """Metadata of every region in the scored batch (many-key lookup = semi join)."""
    return fx.region_metadata(spark, d).join(J.distinct_regions(fx.scored(spark, d), "Region"), "region", "left_semi")


# ---------------------------------------------------------------- sinks / upserts
def q_upsert_predictions(spark, d):
    earlier, current = fx.scored_batches(spark, d)
    old = U.batch_to_predictions(earlier, fx.STOCK_TS)
    return U.upsert_predictions(old, current, fx.RUN_TS)


def q_bucketed_upsert_predictions(spark, d):
    """The same two batches through a bucketed store: the second one rewrites the slots of its regions only."""
    from febrile.sources import bucket_store as BS
    root = scratch_path(spark, "bucket-store")
    for batch, ts in zip(fx.scored_batches(spark, d), (fx.STOCK_TS, fx.RUN_TS), strict=True):
        BS.upsert(spark, root, "predictions", U.batch_to_predictions(batch, ts), U.merge_prediction_records)
    return BS.read(spark, root, "predictions")


def q_merge_region_metadata(spark, d):
    edits = FL.validate_metadata_edits(fx.metadata_edits(spark, d))
    valid = edits.filter(F.col("reject_reason").isNull())
    return U.merge_region_metadata(fx.region_metadata(spark, d), valid, order="edit_seq")


def q_upsert_pharma_stock(spark, d):
    return U.upsert_pharma_stock(fx.pharma_stock(spark, d), q_size_run_stock(spark, d))


# ---------------------------------------------------------------- projections / filters
def q_project_features(spark, d):
    obs = fx.observations(spark, d)
    return FL.project_features(obs, "Region", ["feat_chars", "feat_spaces"], ["feat_lang"], keep=["row_seq"])


def q_join_key_to_features(spark, d):
    """Scored outputs placed beside their features by row key."""
    feats = q_project_features(spark, d)
    outputs = fx.scored(spark, d).drop("Region")
    return feats.join(outputs, "row_seq")


def q_drop_null_labels(spark, d):
    return FL.drop_null_labels(fx.observations(spark, d), "outbreak_label")


def q_select_stage2_training_rows(spark, d):
    rows, _rule = FL.select_stage2_training_rows(fx.observations(spark, d), "outbreak_label", "fever_type")
    return rows


def q_filter_high_risk(spark, d):
    return FL.filter_high_risk(V.region_view(spark, d))


def q_filter_active_alerts(spark, d):
    return FL.filter_active_alerts(V.region_view(spark, d))


def q_filter_mappable(spark, d):
    return FL.filter_mappable(V.region_view(spark, d))


def q_rename_scored_columns(spark, d):
    return FL.rename_scored_columns(fx.scored(spark, d))


def q_stamp_run_ts(spark, d):
    return FL.stamp_run_ts(fx.scored(spark, d), fx.RUN_TS)


def q_validate_metadata_edits(spark, d):
    return FL.validate_metadata_edits(fx.metadata_edits(spark, d))


# ---------------------------------------------------------------- joins
def q_join_region_view(spark, d):
    return V.region_view(spark, d)


def q_lookup_city(spark, d):
    return J.lookup_city(*V.stores(spark, d), LOOKUP_CITY)


def q_regions_missing_coords(spark, d):
    return J.regions_missing_coords(fx.scored(spark, d), fx.region_metadata(spark, d), "Region")


def q_regions_with_cached_coords(spark, d):
    return J.regions_with_cached_coords(fx.scored(spark, d), fx.region_metadata(spark, d), "Region")


# ---------------------------------------------------------------- aggregates
def q_gov_kpis(spark, d):
    return _r6(A.gov_kpis(V.region_view(spark, d)), "avg_risk")


def q_run_summary(spark, d):
    return _r6(A.run_summary(fx.scored_with_nan(spark, d)), "avg_severity")


def q_state_summary(spark, d):
    return A.state_summary(V.region_view(spark, d))


def q_top_fever_type(spark, d):
    return A.top_fever_type(V.region_view(spark, d))


def q_total_stock_units(spark, d):
    return A.total_stock_units(V.region_view(spark, d))


def q_total_demand(spark, d):
    return _r6(A.total_demand(V.region_view(spark, d)), "total_demand")


def q_distinct_regions(spark, d):
    return J.distinct_regions(fx.scored(spark, d), "Region")


def _run_outcomes(spark, d):
    scored, meta, cand = fx.scored(spark, d), fx.region_metadata(spark, d), fx.candidates(spark, d)
    missing = J.regions_missing_coords(scored, meta, "Region")
    resolved = P.resolve_places(missing, cand)
    return P.classify_batch_regions(scored, meta, resolved), resolved


def q_geocode_outcome_summary(spark, d):
    return A.geocode_outcome_summary(_run_outcomes(spark, d)[0])


def q_first_row_per_region(spark, d):
    return U.first_row_per_region(fx.scored(spark, d))


def q_last_row_per_region(spark, d):
    return U.last_row_per_region(fx.scored(spark, d))


# ---------------------------------------------------------------- sort / top-k
def q_priority_action_plan(spark, d):
    return K.priority_action_plan(V.region_view(spark, d))


def q_stock_top6(spark, d):
    return K.stock_top6(V.region_view(spark, d))


def q_highest_risk_region(spark, d):
    return K.highest_risk_region(V.region_view(spark, d))


def q_public_high_risk_3(spark, d):
    return K.public_high_risk_3(V.region_view(spark, d))


# ---------------------------------------------------------------- scalar rules
def q_map_risk_band(spark, d):
    v = FL.filter_mappable(V.region_view(spark, d))
    return v.select("region", "severity_index", R.map_risk_label("severity_index").alias("risk_label"),
                    R.map_risk_color("severity_index").alias("risk_color"))


def q_map_geometry(spark, d):
    v = FL.filter_mappable(V.region_view(spark, d))
    return v.select("region", "lat", "lon", "population",
                    R.map_opacity("severity_index").alias("opacity"),
                    R.map_fill_opacity("severity_index").alias("fill_opacity"),
                    R.map_radius_m("severity_index", "population").alias("radius_m"))


def q_public_risk_band(spark, d):
    v = V.region_view(spark, d)
    s = "severity_index"
    return v.select("region", s, R.public_risk_level(s).alias("risk_level"), R.public_risk_color(s).alias("risk_color"),
                    R.public_risk_bg(s).alias("risk_bg"), R.public_advice(s).alias("advice"))


def q_card_risk_band(spark, d):
    v = V.region_view(spark, d)
    s = "severity_index"
    return v.select("region", s, R.card_fill(s).alias("card_color"), R.card_border(s).alias("border_color"))


def q_safe_float(spark, d):
    """Text fields of the edits parsed with defaults (population 1e6, others 0)."""
    e = fx.metadata_edits(spark, d)
    return e.select("edit_seq", R.safe_float("population", 1_000_000).alias("population_f"),
                    R.safe_float("lat", 0.0).alias("lat_f"), R.safe_float("lon", 0.0).alias("lon_f"))


def q_estimate_population(spark, d):
    c = fx.candidates(spark, d)
    return c.select("city", "result_rank", "place_type", "importance",
                    R.estimate_population("place_type", "importance").alias("population_estimate"))


def q_resolve_places(spark, d):
    return _run_outcomes(spark, d)[1]


def q_extract_state(spark, d):
    c = fx.candidates(spark, d)
    return c.select("city", "result_rank", R.extract_state("address").alias("state"))


def q_format_kpis(spark, d):
    from febrile.plans.dashboards import with_display_text
    text = with_display_text(A.gov_kpis(V.region_view(spark, d)))
    return text.select(*[c for c in text.columns if c.endswith("_text")])


# ---------------------------------------------------------------- stock and demand
def q_size_run_stock(spark, d):
    outcomes, _ = _run_outcomes(spark, d)
    return S.size_run_stock(fx.scored(spark, d), outcomes, fx.RUN_TS)


def q_recommend_stock(spark, d):
    return S.recommend_stock(V.region_view(spark, d))


def q_demand_by_drug(spark, d):
    return S.demand_by_drug(V.region_view(spark, d))


def q_dispatch_orders(spark, d):
    view = V.region_view(spark, d)
    chosen = S.recommend_stock(view).select("region")
    return S.dispatch_orders(view, fx.pharma_stock(spark, d), chosen, DISPATCH_TS)


def q_register_unresolved_region(spark, d):
    outcomes, resolved = _run_outcomes(spark, d)
    return U.merge_region_metadata(fx.region_metadata(spark, d), P.run_metadata_updates(outcomes, resolved))


def q_regeocode_missing(spark, d):
    new_meta, _ = P.regeocode_missing(V.predictions(spark, d), fx.region_metadata(spark, d), fx.candidates(spark, d))
    return new_meta


def q_regeocode_report(spark, d):
    _, report = P.regeocode_missing(V.predictions(spark, d), fx.region_metadata(spark, d), fx.candidates(spark, d))
    return report


def q_pharma_kpis(spark, d):
    return A.pharma_kpis(V.region_view(spark, d))


def q_severity_index(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_seq", R.severity_index("P_Outbreak", "P_Type").alias("severity_index"))


# ---------------------------------------------------------------- sources / sinks with files
def q_scan_csv_inferred(spark, d):
    """Observations with their whole texts and a boolean column written as headered CSV, read back with NA tokens
    and inferred types."""
    from febrile.sources.csv_scan import scan_csv_inferred
    path = scratch_path(spark, "observations-csv")
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("row_seq"), F.col("text").alias("note"))
    rows = fx.observations(spark, d).join(texts, "row_seq").withColumn("is_even", F.col("row_seq") % 2 == 0)
    rows = rows.withColumn("mark", F.concat((F.col("row_seq") % 50).cast("string"), F.lit("D")))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = scan_csv_inferred(spark, path)
    return back.withColumns({"note": F.md5("note"), "note_chars": F.length("note")})


def q_write_scored_csv(spark, d):
    """Scored rows written with a header and read back with the scored schema."""
    from febrile.plans.scoring_job import write_scored_csv
    from febrile.schemas import SCORED
    path = scratch_path(spark, "scored-csv")
    write_scored_csv(fx.scored(spark, d), path)
    return spark.read.schema(SCORED).option("header", True).csv(path)


def _upload(spark, d):
    from febrile.plans.upload_run import run_upload
    from febrile.sources.store import empty_store
    return run_upload(empty_store(spark, "predictions"), fx.region_metadata(spark, d), fx.pharma_stock(spark, d),
                      fx.scored(spark, d), fx.candidates(spark, d), fx.RUN_TS)


def q_upload_run_predictions(spark, d):
    return _upload(spark, d).predictions


def q_upload_run_metadata(spark, d):
    return _upload(spark, d).region_metadata


def q_upload_run_stock(spark, d):
    return _upload(spark, d).pharma_stock


def q_failed_regions(spark, d):
    return P.failed_regions(_run_outcomes(spark, d)[0])


# ---------------------------------------------------------------- dashboard screens
def q_public_search(spark, d):
    from febrile.plans.dashboards import public_search
    return public_search(*V.stores(spark, d), LOOKUP_CITY)


def q_government_map(spark, d):
    from febrile.plans.dashboards import map_table
    return map_table(V.region_view(spark, d))


def core_queries() -> dict[str, Query]:
    return {
        "scan_predictions": q_scan_predictions,
        "lookup_region_metadata": q_lookup_region_metadata,
        "upsert_predictions": q_upsert_predictions,
        "merge_region_metadata": q_merge_region_metadata,
        "upsert_pharma_stock": q_upsert_pharma_stock,
        "project_features": q_project_features,
        "drop_null_labels": q_drop_null_labels,
        "select_stage2_training_rows": q_select_stage2_training_rows,
        "filter_high_risk": q_filter_high_risk,
        "filter_active_alerts": q_filter_active_alerts,
        "filter_mappable": q_filter_mappable,
        "rename_scored_columns": q_rename_scored_columns,
        "stamp_run_ts": q_stamp_run_ts,
        "validate_metadata_edits": q_validate_metadata_edits,
        "join_region_view": q_join_region_view,
        "lookup_city": q_lookup_city,
        "join_key_to_features": q_join_key_to_features,
        "regions_missing_coords": q_regions_missing_coords,
        "regions_with_cached_coords": q_regions_with_cached_coords,
        "gov_kpis": q_gov_kpis,
        "run_summary": q_run_summary,
        "state_summary": q_state_summary,
        "top_fever_type": q_top_fever_type,
        "total_stock_units": q_total_stock_units,
        "total_demand": q_total_demand,
        "distinct_regions": q_distinct_regions,
        "geocode_outcome_summary": q_geocode_outcome_summary,
        "first_row_per_region": q_first_row_per_region,
        "last_row_per_region": q_last_row_per_region,
        "priority_action_plan": q_priority_action_plan,
        "stock_top6": q_stock_top6,
        "highest_risk_region": q_highest_risk_region,
        "public_high_risk_3": q_public_high_risk_3,
        "map_risk_band": q_map_risk_band,
        "map_geometry": q_map_geometry,
        "public_risk_band": q_public_risk_band,
        "card_risk_band": q_card_risk_band,
        "safe_float": q_safe_float,
        "estimate_population": q_estimate_population,
        "resolve_places": q_resolve_places,
        "extract_state": q_extract_state,
        "format_kpis": q_format_kpis,
        "size_run_stock": q_size_run_stock,
        "bucketed_upsert_predictions": q_bucketed_upsert_predictions,
        "recommend_stock": q_recommend_stock,
        "demand_by_drug": q_demand_by_drug,
        "dispatch_orders": q_dispatch_orders,
        "register_unresolved_region": q_register_unresolved_region,
        "regeocode_missing": q_regeocode_missing,
        "regeocode_report": q_regeocode_report,
        "pharma_kpis": q_pharma_kpis,
        "severity_index": q_severity_index,
        "scan_csv_inferred": q_scan_csv_inferred,
        "write_scored_csv": q_write_scored_csv,
        "failed_regions": q_failed_regions,
        "upload_run_predictions": q_upload_run_predictions,
        "upload_run_metadata": q_upload_run_metadata,
        "upload_run_stock": q_upload_run_stock,
        "public_search": q_public_search,
        "government_map": q_government_map,
    }


def all_queries() -> dict[str, Query]:
    from febrile.plans import catalog_ml
    out = core_queries()
    out.update(catalog_ml.ml_queries())
    return out
