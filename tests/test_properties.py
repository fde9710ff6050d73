"""Property tests (few examples each: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from febrile.operators import evaluation as EV
from febrile.operators import joins as J
from febrile.operators import stock as S
from febrile.operators import upserts as U
from febrile.schemas import PREDICTIONS, REGION_METADATA

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
REGIONS = st.sampled_from(["A", "B", "C", "D", "E"])
OPT_D = st.one_of(st.none(), st.floats(-50, 50, allow_nan=False))
OPT_L = st.one_of(st.none(), st.integers(0, 10**7))
OPT_S = st.one_of(st.none(), st.sampled_from(["S1", "S2"]))
META_ROW = st.tuples(REGIONS, OPT_D, OPT_D, OPT_L, OPT_S)
SCORED = "row_seq long, Region string, P_Outbreak double, Fever_Type string, P_Type double, Severity_Index double"


def _unique(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@SETTINGS
@given(old=st.lists(META_ROW, max_size=5), new=st.lists(META_ROW, max_size=5))
def test_merge_never_nulls_an_old_value(spark, old, new):
    o = spark.createDataFrame(_unique(old), REGION_METADATA)
    n = spark.createDataFrame(_unique(new), "region string, lat double, lon double, population long, state string")
    merged = {r["region"]: r for r in U.merge_region_metadata(o, n).collect()}
    for row in _unique(old):
        for i, c in enumerate(["lat", "lon", "population", "state"], start=1):
            if row[i] is not None:
                assert merged[row[0]][c] is not None
    assert set(merged) == {r[0] for r in _unique(old)} | {r[0] for r in _unique(new)}


@SETTINGS
@given(batch=st.lists(st.tuples(REGIONS, st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=12))
def test_upsert_idempotent_and_last_row_wins(spark, batch):
    rows = [(i, r, p, "Viral", t, p * t) for i, (r, p, t) in enumerate(batch)]
    scored = spark.createDataFrame(rows, SCORED)
    empty = spark.createDataFrame([], PREDICTIONS)
    once = U.upsert_predictions(empty, scored, "t")
    twice = U.upsert_predictions(once, scored, "t")
    a, b = sorted(map(tuple, once.collect())), sorted(map(tuple, twice.collect()))
    assert a == b
    last = {}
    for row in rows:
        last[row[1]] = row
    assert {r[0]: r[1] for r in a} == {k: v[2] for k, v in last.items()}
    assert all(0.0 <= r[4] <= 1.0 for r in a)


@SETTINGS
@given(regions=st.lists(REGIONS, min_size=1, max_size=8), meta=st.lists(META_ROW, max_size=5))
def test_cached_and_missing_partition_regions(spark, regions, meta):
    reg = spark.createDataFrame([(r,) for r in regions], "region string")
    m = spark.createDataFrame(_unique(meta), REGION_METADATA)
    cached = {r[0] for r in J.regions_with_cached_coords(reg, m).collect()}
    missing = {r[0] for r in J.regions_missing_coords(reg, m).collect()}
    assert cached.isdisjoint(missing) and cached | missing == set(regions)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from("xyzw")), min_size=1, max_size=30))
def test_confusion_matrix_sums_to_rows(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, p string")
    cm = EV.confusion_matrix(df, "t", "p").collect()
    assert sum(r["n"] for r in cm) == len(pairs) and {(r["y_true"], r["y_pred"]) for r in cm} == set(pairs)


@SETTINGS
@given(rows=st.lists(st.tuples(REGIONS, st.floats(0, 1), OPT_L), min_size=1, max_size=8))
def test_recommended_quantities_respect_floors(spark, rows):
    view = spark.createDataFrame(
        [(r, 0.5, "V", 1.0, s, None, None, p, None, None, None, None, None, "") for r, s, p in _unique(rows)],
        "region string, p_outbreak double, fever_type string, p_type double, severity_index double, lat double, "
        "lon double, population long, state string, paracetamol long, ors long, antibiotics long, iv_fluids long, "
        "ts string")
    for r in S.recommend_stock(view).collect():
        assert r["paracetamol"] >= 50 and r["ors"] >= 30 and r["antibiotics"] >= 20 and r["iv_fluids"] >= 10
