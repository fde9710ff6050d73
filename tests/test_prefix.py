import random

from febrile.operators.prefix import exclusive_prefix_sums


def _expected(rows):
    out, run = {}, {}
    for g, o, v in sorted(rows):
        out[(g, o)] = (run.get(g, 0), None)
        run[g] = run.get(g, 0) + v
    return {k: (b, run[k[0]]) for k, (b, _) in out.items()}


def test_prefix_sums_match_sequential(spark):
    rnd = random.Random(11)
    rows = sorted({(rnd.choice("abc"), rnd.randint(0, 500)): rnd.randint(1, 9) for _ in range(2000)}.items())
    rows = [(g, o, v) for (g, o), v in rows]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    for parts in (1, 3, 64):
        got = {(r["g"], r["o"]): (r["v_before"], r["v_total"])
               for r in exclusive_prefix_sums(df, ["g"], ["o"], ["v"], parts).collect()}
        assert got == _expected(rows)


def test_prefix_sums_single_group_heavy_value(spark):
    # one order value carries most of the weight; rows are distinct values, so partitions stay balanced
    rows = [(0, 10_000)] + [(i, 1) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "o long, v long")
    got = {r["o"]: r["v_before"] for r in exclusive_prefix_sums(df, [], ["o"], ["v"], 16).collect()}
    assert got[0] == 0 and got[1] == 10_000 and got[299] == 10_000 + 298
