
from febrile.operators import places as P
from febrile.schemas import REGION_METADATA

CAND = ("city string, query_rank int, result_rank long, display_name string, place_type string, osm_type string, "
        "lat string, lon string, importance double, address map<string,string>")


def _cands(spark, rows):
    return spark.createDataFrame(rows, CAND)


def test_preference_among_all_matches(spark):
    addr = {"state": "S", "state_district": "D"}
    rows = [
        # query 0: the first match is a road, the preferred city comes 4th
        ("Pune", 0, 1, "Pune road", "road", "node", "1", "2", 0.5, addr),
        ("Pune", 0, 2, "elsewhere", "city", "node", "1", "2", 0.5, addr),
        ("Pune", 0, 3, "pune suburb", "suburb", "node", "3", "4", 0.2, addr),
        ("Pune", 0, 4, "Pune city", "city", "node", "5", "6", 0.9, addr),
    ]
    r = P.resolve_places(spark.createDataFrame([("Pune",)], "region string"), _cands(spark, rows)).first()
    assert (r["result_rank"], r["lat"], r["population"], r["state"]) == (4, 5.0, 13_500_000, "S")
    rows.append(("Pune", 0, 0, "PUNE district", "administrative", "node", "7", "8", None, {"state": ""}))
    r = P.resolve_places(spark.createDataFrame([("Pune",)], "region string"), _cands(spark, rows)).first()
    assert (r["result_rank"], r["population"], r["state"]) == (0, 5_000_000, "India")


def test_fall_through_on_bad_coordinates_and_no_match(spark):
    rows = [("X", 0, 1, "x town", "relation_less", "relation", "bad", "1", 0.5, {}),
            ("X", 1, 1, "nothing", "city", "node", "1", "1", 0.5, {}),
            ("X", 2, 1, "x village", "village", "node", "9", "9", 0.01, {"state_district": "D"})]
    r = P.resolve_places(spark.createDataFrame([("X",)], "region string"), _cands(spark, rows)).first()
    assert (r["query_rank"], r["lat"], r["population"], r["state"]) == (2, 9.0, 50_000, "D")
    none = P.resolve_places(spark.createDataFrame([("Y",)], "region string"), _cands(spark, rows))
    assert none.count() == 0


def test_run_outcomes_and_unknown_records(spark):
    batch = spark.createDataFrame([("A",), ("B",), ("C",)], "Region string")
    meta = spark.createDataFrame([("A", 1.0, 1.0, None, "S"), ("C", 0.0, 0.0, 123, "Manual")], REGION_METADATA)
    resolved = spark.createDataFrame([("B", 5.0, 6.0, "SB", 70000)],
                                     "region string, lat double, lon double, state string, population long")
    out = {r["region"]: (r["outcome"], r["population"]) for r in P.classify_batch_regions(batch, meta, resolved).collect()}
    assert out == {"A": ("cached", 1_000_000), "B": ("resolved", 70000), "C": ("failed", 1_000_000)}
    ups = {r["region"]: tuple(r) for r in P.run_metadata_updates(
        P.classify_batch_regions(batch, meta, resolved), resolved).collect()}
    assert ups["C"] == ("C", None, None, 1_000_000, "Unknown")
    assert ups["B"] == ("B", 5.0, 6.0, 70000, "SB")
