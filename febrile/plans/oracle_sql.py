"""Independent SQL formulations (DuckDB dialect) of the registered queries.

The correctness gate runs these against the same parquet tables and
compares them with the Spark results.  Fixture tables are common table
expressions over the pre-registered table views; last/first-row rules use
``row_number`` windows here (the Spark side uses ``max_by``/``min_by``).
Truncation is written ``CAST(trunc(x) AS BIGINT)`` because a plain cast
rounds in DuckDB; decimal literals are cast to DOUBLE.
"""

from __future__ import annotations

RUN_TS = "2024-02-01T00:00:00+00:00"
STOCK_TS = "2024-01-01T00:00:00+00:00"
DISPATCH_TS = "2024-02-02T00:00:00+00:00"

FIXTURE_CTES = [
    ("observations", """
SELECT d.doc_id AS row_seq, d.source AS Region,
       CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS feat_chars,
       CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS feat_spaces,
       CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE d.lang END AS feat_lang,
       CAST(1 - l.quality AS INTEGER) AS outbreak_label,
       CASE WHEN l.quality = 0 THEN CASE WHEN d.lang = 'en' THEN 'Viral'
                                         WHEN d.lang IN ('de', 'es') THEN 'Dengue' ELSE 'Typhoid' END END AS fever_type
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    ("scored_ev", """
SELECT row_seq, event_ts, Region, P_Outbreak,
       CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE) THEN ft ELSE 'None' END AS Fever_Type,
       CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE) THEN pt ELSE CAST(0 AS DOUBLE) END AS P_Type,
       CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE) THEN P_Outbreak * pt ELSE CAST(0 AS DOUBLE) END AS Severity_Index
FROM (SELECT event_id AS row_seq, ts AS event_ts, 'R' || CAST(user_id AS VARCHAR) AS Region,
             least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS P_Outbreak,
             CASE event_type WHEN 'click' THEN 'Dengue' WHEN 'view' THEN 'Typhoid' ELSE 'Viral' END AS ft,
             CAST(34 + event_id % 67 AS DOUBLE) / CAST(100 AS DOUBLE) AS pt
      FROM events) e"""),
    ("scored", "SELECT row_seq, Region, P_Outbreak, Fever_Type, P_Type, Severity_Index FROM scored_ev"),
    ("region_metadata", """
SELECT 'R' || CAST(c.c_custkey * 3 AS VARCHAR) AS region,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL WHEN c.c_custkey % 11 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(8 + c.c_nationkey AS DOUBLE) END AS lat,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(68 + c.c_nationkey AS DOUBLE) END AS lon,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL
            ELSE CAST(floor((c.c_acctbal + CAST(1000 AS DOUBLE)) * CAST(500 AS DOUBLE)) AS BIGINT) END AS population,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE n.n_name END AS state
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    ("pharma_stock", f"""
SELECT 'R' || CAST(p_partkey * 2 AS VARCHAR) AS region, CAST(p_size AS BIGINT) * 10 AS paracetamol,
       CAST(p_size AS BIGINT) * 8 AS ors, CAST(p_size AS BIGINT) * 6 AS antibiotics,
       CAST(p_size AS BIGINT) * 3 AS iv_fluids, '{STOCK_TS}' AS last_updated
FROM part"""),
    ("candidates", """
SELECT 'R' || CAST(o_custkey * 2 AS VARCHAR) AS city, CAST(o_orderkey % 3 AS INTEGER) AS query_rank,
       o_orderkey AS result_rank,
       CASE WHEN o_orderkey % 4 = 0 THEN 'elsewhere'
            ELSE 'district r' || CAST(o_custkey * 2 AS VARCHAR) || ', country' END AS display_name,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'city' WHEN '2' THEN 'village'
            WHEN '3' THEN 'administrative' WHEN '4' THEN 'road' ELSE 'suburb' END AS place_type,
       CASE WHEN o_orderstatus = 'F' THEN 'relation' ELSE 'node' END AS osm_type,
       CASE WHEN o_orderkey % 17 = 0 THEN 'bad' ELSE CAST(8 + o_custkey % 28 AS VARCHAR) END AS lat,
       CAST(68 + o_custkey % 28 AS VARCHAR) AS lon,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL
            ELSE CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS importance,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'STATE_' || CAST(o_custkey % 25 AS VARCHAR) END AS addr_state,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'DIST_' || CAST(o_custkey % 40 AS VARCHAR) END
           AS addr_state_district
FROM orders"""),
    ("metadata_edits", """
SELECT s_suppkey AS edit_seq,
       CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE 'R' || CAST(s_suppkey AS VARCHAR) END AS region,
       CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 10 = 7 THEN 'abc'
            ELSE CAST(10 + s_nationkey AS VARCHAR) END AS lat,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(70 + s_nationkey AS VARCHAR) END AS lon,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(100000 + s_suppkey AS VARCHAR) END AS population,
       CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'EDITED' END AS state
FROM supplier"""),
    ("evaluated", """
SELECT d.doc_id AS row_id, l.quality AS y_bin,
       CAST((d.doc_id * 37 + l.quality * 20) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score,
       d.lang AS y_true, CASE WHEN d.doc_id % 4 = 0 THEN 'en' ELSE d.lang END AS y_pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    ("predictions", f"""
SELECT Region AS region, P_Outbreak AS p_outbreak, Fever_Type AS fever_type, P_Type AS p_type,
       Severity_Index AS severity_index, '{RUN_TS}' AS ts
FROM (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY row_seq DESC) AS rn FROM scored) t
WHERE rn = 1"""),
    ("scored_nan", """
SELECT row_seq, Region, CASE WHEN row_seq % 31 <> 0 THEN P_Outbreak END AS P_Outbreak, Fever_Type, P_Type,
       CASE WHEN row_seq % 31 <> 0 THEN Severity_Index END AS Severity_Index FROM scored"""),
    ("region_view", f"""
SELECT p.region, p.p_outbreak, coalesce(p.fever_type, '') AS fever_type,
       coalesce(p.p_type, CAST(0 AS DOUBLE)) AS p_type, p.severity_index,
       m.lat, m.lon, m.population, m.state, s.paracetamol, s.ors, s.antibiotics, s.iv_fluids,
       coalesce(p.ts, '') AS ts
FROM (SELECT Region AS region, P_Outbreak AS p_outbreak, Fever_Type AS fever_type, P_Type AS p_type,
             Severity_Index AS severity_index, '{RUN_TS}' AS ts
      FROM (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY row_seq DESC) AS rn FROM scored_nan) t
      WHERE rn = 1) p LEFT JOIN region_metadata m ON p.region = m.region
     LEFT JOIN pharma_stock s ON p.region = s.region"""),
    ("usable_meta", """
SELECT region, population FROM region_metadata
WHERE lat IS NOT NULL AND lat <> 0 AND lon IS NOT NULL AND lon <> 0"""),
    ("batch_regions", "SELECT DISTINCT Region AS region FROM scored"),
    ("missing_regions", """
SELECT region FROM batch_regions WHERE region NOT IN (SELECT region FROM usable_meta)"""),
    ("cand_pick", """
SELECT * FROM (
  SELECT *, row_number() OVER (
      PARTITION BY city, query_rank
      ORDER BY CASE WHEN place_type IN ('city', 'town', 'municipality', 'administrative')
                      OR osm_type = 'relation' THEN 0 ELSE 1 END, result_rank) AS pr
  FROM candidates WHERE city IN (SELECT region FROM missing_regions) AND contains(lower(display_name), lower(city))) t
WHERE pr = 1 AND TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(lon AS DOUBLE) IS NOT NULL"""),
    ("resolved", """
SELECT city AS region, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon,
       coalesce(nullif(addr_state, ''), nullif(addr_state_district, ''), 'India') AS state,
       greatest(CAST(50000 AS BIGINT), CAST(trunc(coalesce(importance, CAST(0.5 AS DOUBLE)) *
           CASE WHEN place_type IN ('city', 'town', 'municipality') THEN CAST(15000000 AS DOUBLE)
                WHEN place_type IN ('village', 'suburb', 'locality') THEN CAST(5000000 AS DOUBLE)
                ELSE CAST(10000000 AS DOUBLE) END) AS BIGINT)) AS population,
       place_type, query_rank, result_rank
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY query_rank) AS qr FROM cand_pick) t
WHERE qr = 1"""),
    ("outcomes", """
SELECT b.region,
       CASE WHEN u.region IS NOT NULL THEN 'cached' WHEN r.region IS NOT NULL THEN 'resolved' ELSE 'failed' END
           AS outcome,
       CASE WHEN u.region IS NOT NULL THEN coalesce(u.population, CAST(1000000 AS BIGINT))
            WHEN r.region IS NOT NULL THEN r.population ELSE CAST(1000000 AS BIGINT) END AS population
FROM batch_regions b LEFT JOIN usable_meta u ON b.region = u.region LEFT JOIN resolved r ON b.region = r.region"""),
    ("run_stock", f"""
SELECT region, base AS paracetamol, CAST(trunc(base * CAST(0.8 AS DOUBLE)) AS BIGINT) AS ors,
       CAST(trunc(base * CAST(0.6 AS DOUBLE)) AS BIGINT) AS antibiotics,
       CAST(trunc(base * CAST(0.3 AS DOUBLE)) AS BIGINT) AS iv_fluids, '{RUN_TS}' AS last_updated
FROM (SELECT f.region, greatest(CAST(50 AS BIGINT), CAST(trunc(CAST(coalesce(o.population, 1000000) AS DOUBLE)
             * f.sev * CAST(0.001 AS DOUBLE)) AS BIGINT)) AS base
      FROM (SELECT Region AS region, Severity_Index AS sev
            FROM (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY row_seq) AS rn FROM scored) t
            WHERE rn = 1) f
      LEFT JOIN outcomes o ON f.region = o.region) b"""),
    ("run_meta_updates", """
SELECT o.region, r.lat, r.lon, r.population, r.state FROM outcomes o JOIN resolved r ON o.region = r.region
WHERE o.outcome = 'resolved'
UNION ALL
SELECT region, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(1000000 AS BIGINT), 'Unknown'
FROM outcomes WHERE outcome = 'failed'"""),
    ("recommended", """
SELECT region, severity,
       greatest(CAST(50 AS BIGINT), base) AS paracetamol,
       greatest(CAST(30 AS BIGINT), CAST(trunc(base * CAST(0.8 AS DOUBLE)) AS BIGINT)) AS ors,
       greatest(CAST(20 AS BIGINT), CAST(trunc(base * CAST(0.6 AS DOUBLE)) AS BIGINT)) AS antibiotics,
       greatest(CAST(10 AS BIGINT), CAST(trunc(base * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS iv_fluids,
       CASE WHEN severity >= CAST(0.6 AS DOUBLE) THEN '#FEE2E2' WHEN severity >= CAST(0.4 AS DOUBLE) THEN '#FED7AA'
            ELSE '#FEF3C7' END AS card_color,
       CASE WHEN severity >= CAST(0.6 AS DOUBLE) THEN '#EF4444' WHEN severity >= CAST(0.4 AS DOUBLE) THEN '#F97316'
            ELSE '#F59E0B' END AS border_color
FROM (SELECT region, coalesce(severity_index, CAST(0 AS DOUBLE)) AS severity,
             CAST(trunc(coalesce(CAST(population AS DOUBLE), CAST(1000000 AS DOUBLE))
                  * coalesce(severity_index, CAST(0 AS DOUBLE)) * CAST(0.001 AS DOUBLE)) AS BIGINT) AS base
      FROM region_view ORDER BY severity_index DESC, region LIMIT 6) t"""),
    ("valid_edits", """
SELECT edit_seq, region, TRY_CAST(nullif(lat, '') AS DOUBLE) AS lat, TRY_CAST(nullif(lon, '') AS DOUBLE) AS lon,
       TRY_CAST(nullif(population, '') AS BIGINT) AS population, nullif(state, '') AS state,
       CASE WHEN coalesce(region, '') = '' THEN 'no region given'
            WHEN nullif(lat, '') IS NOT NULL AND TRY_CAST(nullif(lat, '') AS DOUBLE) IS NULL THEN 'lat is no number'
            WHEN nullif(lon, '') IS NOT NULL AND TRY_CAST(nullif(lon, '') AS DOUBLE) IS NULL THEN 'lon is no number'
            WHEN nullif(population, '') IS NOT NULL AND TRY_CAST(nullif(population, '') AS BIGINT) IS NULL
                THEN 'population is no whole number' END AS reject_reason
FROM metadata_edits"""),
]

_HIGH = "severity_index >= CAST(0.4 AS DOUBLE)"


def with_fixtures(body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in FIXTURE_CTES)
    return f"WITH {ctes}\n{body.strip()}"


def _band(expr: str, bands: list[tuple[str, str]], low: str) -> str:
    whens = " ".join(f"WHEN {expr} >= CAST({edge} AS DOUBLE) THEN '{val}'" for edge, val in bands)
    return f"CASE {whens} ELSE '{low}' END"


def _merge_sql(old: str, new: str, cols: list[str], fill: bool) -> str:
    if fill:
        sel = ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in cols)
    else:
        sel = ", ".join(f"CASE WHEN n.region IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in cols)
    return f"SELECT coalesce(n.region, o.region) AS region, {sel} FROM ({old}) o FULL OUTER JOIN ({new}) n ON o.region = n.region"


_STOCK_COLS = ["paracetamol", "ors", "antibiotics", "iv_fluids", "last_updated"]
_META_COLS = ["lat", "lon", "population", "state"]
_PRED_COLS = ["p_outbreak", "fever_type", "p_type", "severity_index", "ts"]


def _core() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_predictions"] = "SELECT * FROM predictions"
    q["lookup_region_metadata"] = "SELECT * FROM region_metadata WHERE region IN (SELECT region FROM batch_regions)"
    last_of = ("SELECT Region AS region, P_Outbreak AS p_outbreak, Fever_Type AS fever_type, P_Type AS p_type, "
               "Severity_Index AS severity_index, '{ts}' AS ts FROM (SELECT *, row_number() OVER "
               "(PARTITION BY Region ORDER BY row_seq DESC) AS rn FROM scored_ev WHERE {cond}) t WHERE rn = 1")
    old = last_of.format(ts=STOCK_TS, cond="event_ts < TIMESTAMP '2024-01-16 00:00:00'")
    new = last_of.format(ts=RUN_TS, cond="event_ts >= TIMESTAMP '2024-01-16 00:00:00'")
    q["upsert_predictions"] = _merge_sql(old, new, _PRED_COLS, fill=False)
    q["bucketed_upsert_predictions"] = q["upsert_predictions"]
    edits_last = ("SELECT region, "
                  + ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN edit_seq END) AS {c}" for c in _META_COLS)
                  + " FROM valid_edits WHERE reject_reason IS NULL GROUP BY region")
    q["merge_region_metadata"] = _merge_sql("SELECT * FROM region_metadata", edits_last, _META_COLS, fill=True)
    q["upsert_pharma_stock"] = _merge_sql("SELECT * FROM pharma_stock", "SELECT * FROM run_stock", _STOCK_COLS,
                                          fill=False)
    q["project_features"] = "SELECT row_seq, Region, feat_chars, feat_spaces, feat_lang FROM observations"
    q["join_key_to_features"] = ("SELECT o.row_seq, o.Region, feat_chars, feat_spaces, feat_lang, P_Outbreak, s.Fever_Type, "
                                 "P_Type, Severity_Index FROM observations o JOIN scored s ON o.row_seq = s.row_seq")
    q["drop_null_labels"] = "SELECT * FROM observations WHERE outbreak_label IS NOT NULL"
    q["select_stage2_training_rows"] = """
SELECT * FROM observations WHERE fever_type IS NOT NULL AND (
  CASE WHEN (SELECT count(outbreak_label) FROM observations) > 0
        AND (SELECT count(*) FROM observations WHERE outbreak_label = 1 AND fever_type IS NOT NULL) >= 20
       THEN outbreak_label = 1 ELSE TRUE END)"""
    q["filter_high_risk"] = f"SELECT * FROM region_view WHERE {_HIGH}"
    q["filter_active_alerts"] = "SELECT * FROM region_view WHERE p_outbreak >= CAST(0.5 AS DOUBLE)"
    q["filter_mappable"] = "SELECT * FROM region_view WHERE lat IS NOT NULL AND lon IS NOT NULL"
    q["rename_scored_columns"] = ("SELECT row_seq, Region AS region, P_Outbreak AS p_outbreak, Fever_Type AS fever_type, "
                                  "P_Type AS p_type, Severity_Index AS severity_index FROM scored")
    q["stamp_run_ts"] = f"SELECT *, '{RUN_TS}' AS ts FROM scored"
    q["validate_metadata_edits"] = "SELECT * FROM valid_edits"
    q["join_region_view"] = "SELECT * FROM region_view"
    q["lookup_city"] = "SELECT * FROM region_view WHERE region = 'R6'"
    q["regions_missing_coords"] = "SELECT region FROM missing_regions"
    q["regions_with_cached_coords"] = "SELECT region FROM batch_regions WHERE region IN (SELECT region FROM usable_meta)"
    q["gov_kpis"] = f"""
SELECT count(*) FILTER (WHERE {_HIGH}) AS high_risk_districts, count(*) AS total_districts,
       count(*) FILTER (WHERE p_outbreak >= CAST(0.5 AS DOUBLE)) AS active_alerts,
       round(coalesce(avg(severity_index), CAST(0 AS DOUBLE)), 6) AS avg_risk,
       CAST(CASE WHEN count(population) = 0 THEN count(*) FILTER (WHERE {_HIGH}) * 1000000
                 ELSE coalesce(sum(population) FILTER (WHERE {_HIGH}), 0) END AS BIGINT) AS population_at_risk
FROM region_view"""
    q["run_summary"] = """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE Severity_Index >= CAST(0.4 AS DOUBLE)) AS high_risk_rows,
       round(avg(Severity_Index), 6) AS avg_severity,
       count(*) FILTER (WHERE P_Outbreak >= CAST(0.5 AS DOUBLE)) AS alert_rows
FROM scored_nan"""
    q["state_summary"] = ("SELECT state, count(*) AS districts FROM region_view WHERE state IS NOT NULL "
                          "GROUP BY state ORDER BY state")
    q["top_fever_type"] = """
SELECT coalesce((SELECT fever_type FROM region_view WHERE fever_type IS NOT NULL GROUP BY fever_type
                 ORDER BY count(*) DESC, fever_type LIMIT 1), 'N/A') AS top_fever_type"""
    q["total_stock_units"] = "SELECT CAST(count(*) * 10000 AS BIGINT) AS total_stock_units FROM region_view"
    q["total_demand"] = """
SELECT round(coalesce(sum(severity_index * coalesce(CAST(population AS DOUBLE), CAST(1000000 AS DOUBLE))),
                      CAST(0 AS DOUBLE)), 6) AS total_demand FROM region_view"""
    q["distinct_regions"] = "SELECT region FROM batch_regions"
    q["geocode_outcome_summary"] = """
SELECT count(*) FILTER (WHERE outcome = 'resolved') AS newly_geocoded, count(*) FILTER (WHERE outcome = 'cached') AS cached,
       count(*) FILTER (WHERE outcome = 'failed') AS failed FROM outcomes"""
    ranked = ("SELECT row_seq, Region, P_Outbreak, Fever_Type, P_Type, Severity_Index FROM (SELECT *, row_number() "
              "OVER (PARTITION BY Region ORDER BY row_seq {dir}) AS rn FROM scored) t WHERE rn = 1")
    q["first_row_per_region"] = ranked.format(dir="ASC")
    q["last_row_per_region"] = ranked.format(dir="DESC")
    q["priority_action_plan"] = f"""
SELECT region, severity_index,
       {_band('severity_index', [('0.7', 'CRITICAL'), ('0.5', 'HIGH')], 'ELEVATED')} AS badge,
       {_band('severity_index', [('0.7', '#EF4444'), ('0.5', '#F97316')], '#F59E0B')} AS badge_color,
       fever_type, p_outbreak, population
FROM region_view WHERE {_HIGH} ORDER BY severity_index DESC, region"""
    q["stock_top6"] = "SELECT * FROM region_view ORDER BY severity_index DESC, region LIMIT 6"
    q["highest_risk_region"] = """
SELECT coalesce((SELECT region FROM region_view ORDER BY p_outbreak DESC, region LIMIT 1), 'N/A')
       AS highest_risk_region"""
    q["public_high_risk_3"] = f"SELECT region FROM region_view WHERE {_HIGH} ORDER BY region LIMIT 3"
    q["map_risk_band"] = f"""
SELECT region, severity_index,
       {_band('severity_index', [('0.6', 'Critical'), ('0.4', 'High'), ('0.2', 'Moderate')], 'Low')} AS risk_label,
       {_band('severity_index', [('0.6', '#EF4444'), ('0.4', '#F97316'), ('0.2', '#F59E0B')], '#10B981')} AS risk_color
FROM region_view WHERE lat IS NOT NULL AND lon IS NOT NULL"""
    q["map_geometry"] = """
SELECT region, lat, lon, population,
       CAST(0.4 AS DOUBLE) + severity_index * CAST(0.6 AS DOUBLE) AS opacity,
       (CAST(0.4 AS DOUBLE) + severity_index * CAST(0.6 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS fill_opacity,
       CASE WHEN population > 0 THEN greatest(CAST(2000 AS DOUBLE), least(CAST(20000 AS DOUBLE),
                 sqrt(CAST(population AS DOUBLE) / CAST(5000 AS DOUBLE) / pi()) * CAST(1000 AS DOUBLE)))
            ELSE CAST(3000 AS DOUBLE) + severity_index * CAST(7000 AS DOUBLE) END AS radius_m
FROM region_view WHERE lat IS NOT NULL AND lon IS NOT NULL"""
    q["public_risk_band"] = f"""
SELECT region, severity_index,
       {_band('severity_index', [('0.4', 'HIGH RISK'), ('0.2', 'MODERATE RISK')], 'LOW RISK')} AS risk_level,
       {_band('severity_index', [('0.4', '#EF4444'), ('0.2', '#F59E0B')], '#10B981')} AS risk_color,
       {_band('severity_index', [('0.4', '#FEE2E2'), ('0.2', '#FEF3C7')], '#D1FAE5')} AS risk_bg,
       {_band('severity_index', [('0.4', 'High risk detected. Take immediate precautions and seek medical help if symptomatic.'),
                                 ('0.2', 'Moderate risk level. Be vigilant and follow preventive measures.')],
              'Low risk currently. Continue following regular hygiene practices.')} AS advice
FROM region_view"""
    q["card_risk_band"] = f"""
SELECT region, severity_index,
       {_band('severity_index', [('0.6', '#FEE2E2'), ('0.4', '#FED7AA')], '#FEF3C7')} AS card_color,
       {_band('severity_index', [('0.6', '#EF4444'), ('0.4', '#F97316')], '#F59E0B')} AS border_color
FROM region_view"""
    safe = ("CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL OR isnan(TRY_CAST({c} AS DOUBLE)) THEN CAST({d} AS DOUBLE) "
            "ELSE TRY_CAST({c} AS DOUBLE) END")
    q["safe_float"] = (f"SELECT edit_seq, {safe.format(c='population', d=1000000)} AS population_f, "
                       f"{safe.format(c='lat', d=0)} AS lat_f, {safe.format(c='lon', d=0)} AS lon_f FROM metadata_edits")
    q["estimate_population"] = """
SELECT city, result_rank, place_type, importance,
       greatest(CAST(50000 AS BIGINT), CAST(trunc(coalesce(importance, CAST(0.5 AS DOUBLE)) *
           CASE WHEN place_type IN ('city', 'town', 'municipality') THEN CAST(15000000 AS DOUBLE)
                WHEN place_type IN ('village', 'suburb', 'locality') THEN CAST(5000000 AS DOUBLE)
                ELSE CAST(10000000 AS DOUBLE) END) AS BIGINT)) AS population_estimate
FROM candidates"""
    q["resolve_places"] = "SELECT * FROM resolved"
    q["extract_state"] = ("SELECT city, result_rank, coalesce(nullif(addr_state, ''), nullif(addr_state_district, ''), "
                          "'India') AS state FROM candidates")
    q["format_kpis"] = f"""
SELECT CAST(count(*) FILTER (WHERE {_HIGH}) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS high_risk_text,
       CAST(count(*) FILTER (WHERE p_outbreak >= CAST(0.5 AS DOUBLE)) AS VARCHAR) AS active_alerts_text,
       printf('%.2f', coalesce(avg(severity_index), CAST(0 AS DOUBLE))) AS avg_risk_text,
       printf('%.3f', coalesce(avg(severity_index), CAST(0 AS DOUBLE))) AS avg_risk_3_text,
       printf('%.1f', coalesce(avg(severity_index), CAST(0 AS DOUBLE)) * 100) || '%' AS avg_risk_pct_text,
       format('{{:,}}', CAST(CASE WHEN count(population) = 0 THEN count(*) FILTER (WHERE {_HIGH}) * 1000000
                 ELSE coalesce(sum(population) FILTER (WHERE {_HIGH}), 0) END AS BIGINT)) AS population_at_risk_text
FROM region_view"""
    q["size_run_stock"] = "SELECT * FROM run_stock"
    q["recommend_stock"] = "SELECT * FROM recommended"
    q["demand_by_drug"] = """
SELECT d.drug, d.share, CAST(trunc(t.total * d.share / CAST(100000 AS DOUBLE)) AS BIGINT) AS required
FROM (SELECT coalesce(sum(severity_index * coalesce(CAST(population AS DOUBLE), CAST(1000000 AS DOUBLE))),
                      CAST(0 AS DOUBLE)) AS total FROM region_view) t,
     (VALUES ('Paracetamol', CAST(0.5 AS DOUBLE)), ('ORS Packets', CAST(0.3 AS DOUBLE)),
             ('Antibiotics', CAST(0.15 AS DOUBLE)), ('IV Fluids', CAST(0.05 AS DOUBLE))) d(drug, share)"""
    disp_new = (f"SELECT region, paracetamol, ors, antibiotics, iv_fluids, '{DISPATCH_TS}' AS last_updated "
                "FROM recommended")
    q["dispatch_orders"] = _merge_sql("SELECT * FROM pharma_stock", disp_new, _STOCK_COLS, fill=False)
    q["register_unresolved_region"] = _merge_sql("SELECT * FROM region_metadata", "SELECT * FROM run_meta_updates",
                                                 _META_COLS, fill=True)
    regeo_missing = ("SELECT region FROM predictions WHERE region NOT IN (SELECT region FROM usable_meta)")
    q["regeocode_missing"] = _merge_sql(
        "SELECT * FROM region_metadata",
        "SELECT region, lat, lon, population, state FROM resolved WHERE region IN (" + regeo_missing + ")",
        _META_COLS, fill=True)
    q["regeocode_report"] = f"""
SELECT count(r.region) AS resolved, count(*) AS total
FROM ({regeo_missing}) m LEFT JOIN resolved r ON m.region = r.region"""
    q["pharma_kpis"] = """
SELECT CAST(count(*) * 10000 AS BIGINT) AS total_stock_units,
       coalesce((SELECT fever_type FROM region_view WHERE fever_type IS NOT NULL GROUP BY fever_type
                 ORDER BY count(*) DESC, fever_type LIMIT 1), 'N/A') AS top_fever_type,
       coalesce((SELECT region FROM region_view ORDER BY p_outbreak DESC, region LIMIT 1), 'N/A')
           AS highest_risk_region,
       80 AS stock_fulfilment_pct
FROM region_view"""
    q["severity_index"] = "SELECT row_seq, P_Outbreak * P_Type AS severity_index FROM scored"
    q["scan_csv_inferred"] = """
SELECT o.row_seq, o.Region, feat_chars, feat_spaces, feat_lang, CAST(outbreak_label AS DOUBLE) AS outbreak_label,
       o.fever_type, o.row_seq % 2 = 0 AS is_even, CAST(o.row_seq % 50 AS VARCHAR) || 'D' AS mark, md5(d.text) AS note,
       CAST(length(d.text) AS INTEGER) AS note_chars
FROM observations o JOIN documents d ON o.row_seq = d.doc_id"""
    q["failed_regions"] = "SELECT region FROM outcomes WHERE outcome = 'failed'"
    q["write_scored_csv"] = "SELECT * FROM scored"
    q["upload_run_predictions"] = q["scan_predictions"]
    q["upload_run_metadata"] = q["register_unresolved_region"]
    q["upload_run_stock"] = q["upsert_pharma_stock"]
    q["public_search"] = f"""
SELECT region, severity_index, fever_type, p_outbreak, population, state,
       {_band('severity_index', [('0.4', 'HIGH RISK'), ('0.2', 'MODERATE RISK')], 'LOW RISK')} AS risk_level,
       {_band('severity_index', [('0.4', '#EF4444'), ('0.2', '#F59E0B')], '#10B981')} AS risk_color,
       {_band('severity_index', [('0.4', '#FEE2E2'), ('0.2', '#FEF3C7')], '#D1FAE5')} AS risk_bg,
       {_band('severity_index', [('0.4', 'High risk detected. Take immediate precautions and seek medical help if symptomatic.'),
                                 ('0.2', 'Moderate risk level. Be vigilant and follow preventive measures.')],
              'Low risk currently. Continue following regular hygiene practices.')} AS advice
FROM region_view WHERE region = 'R6'"""
    q["government_map"] = f"""
SELECT region, lat, lon, population, state, fever_type, p_outbreak, severity_index,
       {_band('severity_index', [('0.6', 'Critical'), ('0.4', 'High'), ('0.2', 'Moderate')], 'Low')} AS risk_label,
       {_band('severity_index', [('0.6', '#EF4444'), ('0.4', '#F97316'), ('0.2', '#F59E0B')], '#10B981')} AS risk_color,
       CAST(0.4 AS DOUBLE) + severity_index * CAST(0.6 AS DOUBLE) AS opacity,
       (CAST(0.4 AS DOUBLE) + severity_index * CAST(0.6 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS fill_opacity,
       CASE WHEN population > 0 THEN greatest(CAST(2000 AS DOUBLE), least(CAST(20000 AS DOUBLE),
                 sqrt(CAST(population AS DOUBLE) / CAST(5000 AS DOUBLE) / pi()) * CAST(1000 AS DOUBLE)))
            ELSE CAST(3000 AS DOUBLE) + severity_index * CAST(7000 AS DOUBLE) END AS radius_m
FROM region_view WHERE lat IS NOT NULL AND lon IS NOT NULL"""
    return q


def oracle_queries() -> dict[str, str]:
    from febrile.plans import oracle_ml
    out = {k: with_fixtures(v) for k, v in _core().items()}
    out.update({k: with_fixtures(v) for k, v in oracle_ml.queries().items()})
    return out
