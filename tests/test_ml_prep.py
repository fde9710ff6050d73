import random
import statistics

import pytest
from pyspark.sql import functions as F

from febrile.operators import ml_prep as MP


def test_exact_median_matches_python(spark):
    rnd = random.Random(3)
    xs = [float(rnd.randint(0, 30)) for _ in range(501)] + [None] * 7
    ys = [float(rnd.random()) for _ in range(508)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    med = {r["feature"]: r["median"] for r in MP.exact_medians(df, ["x", "y"]).collect()}
    assert med["x"] == statistics.median([v for v in xs if v is not None])
    assert med["y"] == pytest.approx(statistics.median(ys), abs=1e-15)


def test_even_count_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert MP.exact_medians(df, ["x"]).first()["median"] == 3.0


def test_scale_uses_population_std_and_unit_for_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    med = {r["feature"]: r["median"] for r in MP.exact_medians(df, ["x", "c"]).collect()}
    mom = {r["feature"]: r for r in MP.numeric_moments(df, ["x", "c"], med).collect()}
    vals = [1.0, 2.0, 3.0, 2.0]
    assert mom["x"]["mean"] == pytest.approx(statistics.fmean(vals))
    assert mom["x"]["scale"] == pytest.approx(statistics.pstdev(vals))
    assert mom["c"]["scale"] == 1.0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "k string")
    assert MP.categorical_modes(df, ["k"]).first()["mode"] == "a"


def test_one_hot_unknown_is_all_zero(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None)], "x double, k string")
    prep = MP.fit_preprocessor(train, ["x"], ["k"])
    test = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (1.0, "zzz"), (None, None)], "x double, k string")
    out = MP.one_hot_index(prep.transform(test), "k").select("k_hot_index", "features").collect()
    assert [r[0] for r in out] == [0, 1, None, 0]      # null -> mode 'a'
    assert out[2]["features"].toArray().tolist()[1:] == [0.0, 0.0]


def test_stratified_split_exact_and_deterministic(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, y int")
    s = MP.stratified_split(df, "y", "id", 0.2, 42)
    counts = {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    n_test = counts[(0, "test")] + counts[(1, "test")]
    assert n_test == 200                                    # ceil(0.2 * 997)
    assert counts[(1, "train")] + counts[(1, "test")] == 200
    assert abs(counts[(1, "test")] - 40) <= 1
    again = MP.stratified_split(df, "y", "id", 0.2, 42)
    a = {r["id"]: r["split"] for r in s.collect()}
    b = {r["id"]: r["split"] for r in again.collect()}
    assert a == b and len(a) == 997


def test_split_rejects_singleton_class(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, 1)], "id long, y int")
    with pytest.raises(ValueError, match="single row"):
        MP.stratified_split(df, "y", "id", 0.2, 42)


def test_medians_by_brackets_with_heavy_ties(spark, monkeypatch):
    monkeypatch.setattr(MP, "FETCHED", 8)
    rnd = random.Random(8)
    columns = {
        "half": [rnd.choice([1.0, 2.0]) for _ in range(999)],              # two values, ties on both ends
        "third": [7.5 if i % 3 == 0 else rnd.gauss(0, 50) for i in range(999)],
        "flat": [3.0] * 999,
        "wide": [rnd.uniform(-1e300, 1e300) for _ in range(999)],
        "gaps": [float(i // 2) if i % 7 else None for i in range(999)],
        "nan": [float("nan") if i % 2 else float(i * i) for i in range(999)],
        "none": [None] * 999,
        "edge": [float("-inf") if i < 300 else float("inf") if i > 700 else float(i) for i in range(999)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = {r["feature"]: r["median"] for r in MP.exact_medians(df, list(columns)).collect()}
    for c, values in columns.items():
        held = [v for v in values if v is not None and v == v]
        assert got.get(c) == (statistics.median(held) if held else None), c
    assert MP.exact_medians(df.limit(0), ["half"]).count() == 0 and MP.exact_medians(df, []).count() == 0


def test_medians_of_an_even_gap_between_two_far_values(spark, monkeypatch):
    monkeypatch.setattr(MP, "FETCHED", 4)
    df = spark.range(2_000).select(F.when(F.col("id") < 1_000, F.col("id")).otherwise(F.col("id") * 1_000_000).cast("double").alias("x"))
    assert MP.exact_medians(df, ["x"]).first()["median"] == (999 + 1_000_000_000) / 2


def test_split_by_refined_buckets_is_the_split_by_rank(spark, monkeypatch):
    import hashlib
    rows = [(i, "abc"[(i * i) % 7 % 3], i % 5) for i in range(3_000)] + [(9_999, None, 1)]
    df = spark.createDataFrame(rows, "id long, y string, split_of int")
    key = lambda i: (int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:15], 16), i)
    want = {9_999: None}
    quota = MP._quotas({c: sum(r[1] == c for r in rows) for c in "abc"}, 0.2)
    for c in "abc":
        for k, i in enumerate(sorted((r[0] for r in rows if r[1] == c), key=key)):
            want[i] = "train" if k < quota[c] else "test"
    assert {r["id"]: r["split"] for r in MP.stratified_split(df, "y", "id").collect()} == want
    monkeypatch.setattr(MP, "PASS_BITS", 3)     # many passes over small buckets
    monkeypatch.setattr(MP, "RANKED", 2)
    assert {r["id"]: r["split"] for r in MP.stratified_split(df, "y", "id").collect()} == want
