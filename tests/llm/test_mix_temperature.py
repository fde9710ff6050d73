import math

import pytest
from pyspark.sql import functions as F

import llm_cases as cases
from febrile.llm.mix_temperature import MixTarget, bisect_exponent, mix, source_weights


def corpus(spark, sizes):
    rows = [(k * 10_000 + i, "tok " * (1 + i % 5), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def stats(spark, tokens):
    return spark.createDataFrame([(k, 1, t) for k, t in tokens.items()], "skey string, n_docs long, tokens long")


def test_repetition_limit_is_met_exactly(spark):
    s = stats(spark, {"a": 100_000, "b": 5_000, "c": 20})
    a = bisect_exponent(s, MixTarget(max_repetition=4.0))
    assert (100_000 / 20) ** (1 - a) == pytest.approx(4.0, rel=1e-5) and (100_000 / 20) ** (1 - a) <= 4.0
    w = {r["skey"]: r for r in source_weights(s, MixTarget(max_repetition=4.0)).collect()}
    assert sum(r["weight"] for r in w.values()) == pytest.approx(1)
    assert w["a"]["budget"] == 100_000 and w["c"]["budget"] == 80
    assert bisect_exponent(stats(spark, {"a": 10, "b": 10}), MixTarget(max_repetition=3.0)) < 1e-6


def test_entropy_target(spark):
    tokens = {"a": 90_000, "b": 9_000, "c": 1_000}
    a = bisect_exponent(stats(spark, tokens), MixTarget(max_repetition=None, min_entropy_share=0.9))
    p = [t ** a for t in tokens.values()]
    p = [x / sum(p) for x in p]
    assert -sum(x * math.log(x) for x in p) / math.log(3) == pytest.approx(0.9, abs=1e-5)
    assert bisect_exponent(stats(spark, tokens), MixTarget(max_repetition=None, min_entropy_share=0.1)) == 1.0
    with pytest.raises(ValueError):
        MixTarget(max_repetition=2.0, min_entropy_share=0.5)


def test_budgets_are_read_in_whole_epochs_and_a_cut_one(spark):
    docs = corpus(spark, {"big": 900, "mid": 90, "small": 9})
    out = mix(docs, MixTarget(max_repetition=2.5)).cache()
    per = {r["source"]: r for r in out.groupBy("source").agg(
        F.sum("n_tokens").alias("read"), F.max("budget").alias("budget"), F.countDistinct("doc_id").alias("ids"),
        F.max("epoch").alias("last")).collect()}
    assert {s: r["ids"] for s, r in per.items()} == {"big": 900, "mid": 90, "small": 9}   # nothing is lost
    for r in per.values():
        assert r["budget"] - 5 < r["read"] <= r["budget"]
    twice = out.groupBy("doc_id", "epoch").count().filter("count > 1").count()
    assert twice == 0 and per["small"]["last"] == 2
    again = mix(docs, MixTarget(max_repetition=2.5))
    assert out.exceptAll(again).count() == 0


def test_a_smaller_budget_takes_part_of_the_large_sources(spark):
    docs = corpus(spark, {"big": 900, "small": 9})
    out = mix(docs, MixTarget(max_repetition=2.0, budget_tokens=600))
    assert 560 < out.agg(F.sum("n_tokens")).first()[0] <= 600


def test_blocks_keep_the_weights_from_the_start(spark):
    docs = corpus(spark, {"big": 900, "mid": 300})
    out = mix(docs, MixTarget(max_repetition=1.5)).withColumn("at", F.col("block_start") / F.col("budget"))
    half = {r["source"]: r["n"] for r in out.filter("at < 0.5").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    full = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(0.4 < half[s] / full[s] < 0.62 for s in full)


def test_odd_rows(spark):
    out = mix(cases.table(spark), MixTarget(max_repetition=2.0))
    assert {"doc_id", "text", "score", "epoch"} <= set(out.columns) and dict(out.dtypes)["block"] == "int"
    first = out.filter("epoch = 0").count()
    assert first == len(cases.rows())
    assert mix(cases.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, " ", None)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in mix(blank).collect()) == [1, 2, 3]


def test_native_plan(spark):
    plan = mix(corpus(spark, {"a": 20, "b": 5}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
