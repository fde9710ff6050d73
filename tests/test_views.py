from febrile.operators import aggregates as A
from febrile.operators import joins as J
from febrile.operators import stock as S
from febrile.operators import topk as K
from febrile.operators.filters import filter_mappable
from febrile.schemas import PHARMA_STOCK, PREDICTIONS, REGION_METADATA

VIEW = ("region string, p_outbreak double, fever_type string, p_type double, severity_index double, lat double, "
        "lon double, population long, state string, paracetamol long, ors long, antibiotics long, iv_fluids long, "
        "ts string")


def _view(spark, rows):
    full = [(r + (None,) * 14)[:14] for r in rows]
    return spark.createDataFrame(full, VIEW)


def test_join_defaults_and_row_count(spark):
    preds = spark.createDataFrame([("A", None, None, None, None, None), ("B", 0.5, "Viral", 0.5, 0.25, "t")], PREDICTIONS)
    meta = spark.createDataFrame([("A", 1.0, 2.0, 10, "S")], REGION_METADATA)
    stock = spark.createDataFrame([("B", 1, 2, 3, 4, "t")], PHARMA_STOCK)
    v = {r["region"]: r for r in J.join_region_view(preds, meta, stock).collect()}
    assert len(v) == 2
    assert (v["A"]["p_outbreak"], v["A"]["fever_type"], v["A"]["ts"]) == (0.0, "", "")
    assert v["A"]["state"] == "S" and v["A"]["paracetamol"] is None
    assert v["B"]["lat"] is None and v["B"]["iv_fluids"] == 4


def test_lookup_city_exact(spark):
    preds = spark.createDataFrame([("Pune", 0.5, "Viral", 0.5, 0.25, "t")], PREDICTIONS)
    meta = spark.createDataFrame([], REGION_METADATA)
    stock = spark.createDataFrame([], PHARMA_STOCK)
    assert J.lookup_city(preds, meta, stock, "Pune").count() == 1
    assert J.lookup_city(preds, meta, stock, "pune").count() == 0


def test_gov_kpis_population_rules(spark):
    # some populations known: sum of high-risk known ones
    v = _view(spark, [("A", 0.6, "V", 1.0, 0.5, 1.0, 1.0, 100), ("B", 0.4, "V", 1.0, 0.45, 1.0, 1.0, None),
                      ("C", 0.2, "V", 1.0, 0.1, 1.0, 1.0, 5)])
    r = A.gov_kpis(v).first()
    assert (r["high_risk_districts"], r["total_districts"], r["active_alerts"], r["population_at_risk"]) == (2, 3, 1, 100)
    # all populations null: rows x 1,000,000
    v2 = _view(spark, [("A", 0.6, "V", 1.0, 0.5), ("B", 0.4, "V", 1.0, 0.45)])
    assert A.gov_kpis(v2).first()["population_at_risk"] == 2_000_000
    # known populations only in low-risk rows: 0
    v3 = _view(spark, [("A", 0.6, "V", 1.0, 0.5, None, None, None), ("B", 0.1, "V", 1.0, 0.1, None, None, 9)])
    assert A.gov_kpis(v3).first()["population_at_risk"] == 0


def test_empty_store_kpis(spark):
    v = _view(spark, [])
    r = A.gov_kpis(v).first()
    assert tuple(r) == (0, 0, 0, 0.0, 0)
    p = A.pharma_kpis(v).first()
    assert tuple(p) == (0, "N/A", "N/A", 80)
    assert K.highest_risk_region(v).first()[0] == "N/A"
    assert A.top_fever_type(v).first()[0] == "N/A"
    assert [tuple(r) for r in S.demand_by_drug(v).collect()] == [
        ("Paracetamol", 0.5, 0), ("ORS Packets", 0.3, 0), ("Antibiotics", 0.15, 0), ("IV Fluids", 0.05, 0)]


def test_ties(spark):
    v = _view(spark, [("B", 0.9, "Viral", 1.0, 0.5), ("A", 0.9, "Dengue", 1.0, 0.5), ("C", 0.1, "None", 0.0, 0.0),
                      ("D", 0.2, "None", 0.0, 0.0), ("E", 0.3, "Viral", 1.0, 0.3), ("F", 0.3, "Dengue", 1.0, 0.3)])
    assert K.highest_risk_region(v).first()[0] == "A"
    # Dengue 2, Viral 2, None 2 -> smallest of the tied values
    assert A.top_fever_type(v).first()[0] == "Dengue"
    p = A.pharma_kpis(v).first()
    assert (p["top_fever_type"], p["highest_risk_region"], p["total_stock_units"]) == ("Dengue", "A", 60000)
    assert [r[0] for r in K.public_high_risk_3(v).collect()] == ["A", "B"]


def test_mappable_keeps_zero_coordinates(spark):
    v = _view(spark, [("A", 0.1, "", 0.0, 0.0, 0.0, 0.0), ("B", 0.1, "", 0.0, 0.0, None, 1.0),
                      ("C", 0.1, "", 0.0, 0.0, 1.0, 1.0)])
    assert sorted(r["region"] for r in filter_mappable(v).collect()) == ["A", "C"]


def test_recommend_stock_floors(spark):
    # base = int(pop * sev * 0.001): 0, 49, 50, 62
    v = _view(spark, [("A", 1.0, "V", 1.0, 0.0, None, None, 1000), ("B", 1.0, "V", 1.0, 0.499, None, None, 100000),
                      ("C", 1.0, "V", 1.0, 0.5, None, None, 100000), ("D", 1.0, "V", 1.0, 0.625, None, None, 100000),
                      ("E", 1.0, "V", 1.0, 0.3, None, None, None)])
    rec = {r["region"]: r for r in S.recommend_stock(v).collect()}
    assert (rec["A"]["paracetamol"], rec["A"]["ors"], rec["A"]["antibiotics"], rec["A"]["iv_fluids"]) == (50, 30, 20, 10)
    assert rec["B"]["paracetamol"] == 50 and rec["C"]["paracetamol"] == 50
    assert (rec["D"]["paracetamol"], rec["D"]["ors"], rec["D"]["antibiotics"], rec["D"]["iv_fluids"]) == (62, 49, 37, 18)
    assert rec["E"]["paracetamol"] == 300          # null population -> 1,000,000
    assert rec["D"]["card_color"] == "#FEE2E2" and rec["E"]["card_color"] == "#FEF3C7"


def test_run_stock_floors_base_first(spark):
    scored = spark.createDataFrame([(1, "A", 1.0, "V", 0.625, 0.625), (2, "A", 1.0, "V", 1.0, 1.0),
                                    (3, "B", 1.0, "V", 0.01, 0.01)],
                                   "row_seq long, Region string, P_Outbreak double, Fever_Type string, P_Type double, "
                                   "Severity_Index double")
    pops = spark.createDataFrame([("A", 100000), ("B", None)], "region string, population long")
    out = {r["region"]: r for r in S.size_run_stock(scored, pops, "t").collect()}
    # A uses its first row (0.625): base 62 -> 62, 49, 37, 18
    assert (out["A"]["paracetamol"], out["A"]["ors"], out["A"]["antibiotics"], out["A"]["iv_fluids"]) == (62, 49, 37, 18)
    # B: base floored to 50 first, then derived: 50, 40, 30, 15
    assert (out["B"]["paracetamol"], out["B"]["ors"], out["B"]["antibiotics"], out["B"]["iv_fluids"]) == (50, 40, 30, 15)


def test_state_summary_and_priority(spark):
    v = _view(spark, [("A", 0.9, "V", 1.0, 0.75, 1.0, 1.0, None, "S2"), ("B", 0.9, "V", 1.0, 0.55, 1.0, 1.0, 5, "S1"),
                      ("C", 0.9, "V", 1.0, 0.4, 1.0, 1.0, 5, None), ("D", 0.1, "V", 1.0, 0.1, 1.0, 1.0, 5, "S1")])
    assert [tuple(r) for r in A.state_summary(v).collect()] == [("S1", 2), ("S2", 1)]
    plan = [(r["region"], r["badge"]) for r in K.priority_action_plan(v).collect()]
    assert plan == [("A", "CRITICAL"), ("B", "HIGH"), ("C", "ELEVATED")]


def test_cached_and_missing_partition_regions(spark):
    regions = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("A",)], "region string")
    meta = spark.createDataFrame([("A", 1.0, 1.0, None, None), ("B", 0.0, 1.0, None, None), ("C", None, 1.0, None, None)],
                                 REGION_METADATA)
    cached = {r[0] for r in J.regions_with_cached_coords(regions, meta).collect()}
    missing = {r[0] for r in J.regions_missing_coords(regions, meta).collect()}
    assert cached == {"A"} and missing == {"B", "C", "D"}
