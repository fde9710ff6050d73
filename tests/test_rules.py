import math

from pyspark.sql import functions as F

from febrile.functions import rules as R

EDGES = [0.0, 0.19, 0.2, 0.39, 0.4, 0.49, 0.5, 0.59, 0.6, 0.69, 0.7, 1.0]


def _apply(spark, values, expr, schema="v double"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_map_band_edges(spark):
    got = _apply(spark, EDGES, R.map_risk_label)
    assert got == ["Low", "Low", "Moderate", "Moderate", "High", "High", "High", "High",
                   "Critical", "Critical", "Critical", "Critical"]
    colors = _apply(spark, [0.1, 0.2, 0.4, 0.6], R.map_risk_color)
    assert colors == ["#10B981", "#F59E0B", "#F97316", "#EF4444"]


def test_public_and_card_bands(spark):
    assert _apply(spark, [0.19, 0.2, 0.39, 0.4], R.public_risk_level) == [
        "LOW RISK", "MODERATE RISK", "MODERATE RISK", "HIGH RISK"]
    assert _apply(spark, [0.39, 0.4, 0.59, 0.6], R.card_fill) == ["#FEF3C7", "#FED7AA", "#FED7AA", "#FEE2E2"]
    assert _apply(spark, [0.4, 0.49, 0.5, 0.69, 0.7], R.priority_badge) == [
        "ELEVATED", "ELEVATED", "HIGH", "HIGH", "CRITICAL"]


def test_null_and_nan_severity(spark):
    # null falls to the lowest band; NaN is turned into null on ingest
    assert _apply(spark, [None], R.map_risk_label) == ["Low"]
    assert _apply(spark, [float("nan")], lambda c: R.map_risk_label(R.nan_to_null(c))) == ["Low"]


def test_truncation_toward_zero(spark):
    assert _apply(spark, [2.7, -2.7, 49.9], R.trunc_long) == [2, -2, 49]


def test_map_geometry(spark):
    df = spark.createDataFrame([(0.5, 1_000_000), (0.5, None), (0.5, 0), (1.0, 10)], "s double, p long")
    rows = df.select(R.map_radius_m("s", "p").alias("r"), R.map_opacity("s").alias("o"),
                     R.map_fill_opacity("s").alias("f")).collect()
    expected = max(2000, min(20000, math.sqrt(1_000_000 / 5000 / math.pi) * 1000))
    assert abs(rows[0]["r"] - expected) < 1e-9
    assert rows[1]["r"] == 3000 + 0.5 * 7000     # null population -> severity rule
    assert rows[2]["r"] == 3000 + 0.5 * 7000     # zero population -> severity rule
    assert rows[3]["r"] == 2000                   # clamped
    assert abs(rows[0]["o"] - 0.7) < 1e-12 and abs(rows[0]["f"] - 0.35) < 1e-12


def test_usable_coords(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (1.0, 0.0), (1.0, 2.0)], "lat double, lon double")
    assert [r[0] for r in df.select(R.usable_coords()).collect()] == [False, False, False, True]


def test_safe_float(spark):
    got = _apply(spark, ["12.5", "abc", None, "", "nan"], lambda c: R.safe_float(c, 7.0), "v string")
    assert got == [12.5, 7.0, 7.0, 7.0, 7.0]


def test_estimate_population(spark):
    df = spark.createDataFrame([("city", 0.5), ("village", 0.5), ("road", 0.5), ("city", None), ("town", 0.001)],
                               "t string, i double")
    got = [r[0] for r in df.select(R.estimate_population("t", "i")).collect()]
    assert got == [7_500_000, 2_500_000, 5_000_000, 7_500_000, 50_000]


def test_extract_state(spark):
    df = spark.createDataFrame([({"state": "A", "state_district": "B"},), ({"state": "", "state_district": "B"},),
                                ({"state": "", "state_district": None},), (None,)],
                               "a map<string,string>")
    assert [r[0] for r in df.select(R.extract_state("a")).collect()] == ["A", "B", "India", "India"]


def test_format(spark):
    df = spark.createDataFrame([(0.1234, 1234567)], "x double, n long")
    r = df.select(R.fmt_pct("x", 1), R.fmt_fixed("x", 3), R.fmt_thousands("n")).first()
    assert tuple(r) == ("12.3%", "0.123", "1,234,567")
