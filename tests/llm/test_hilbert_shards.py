import itertools
import zlib

import pytest

import llm_cases as cases
from febrile.llm.hilbert_shards import curve_tables, hilbert_index, hilbert_shards


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 3)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(n, bits):
    place, state = curve_tables(n)
    at = {}
    for point in itertools.product(range(1 << bits), repeat=n):
        s = index = 0
        for level in reversed(range(bits)):
            cell = s * (1 << n) + sum((x >> level & 1) << k for k, x in enumerate(point))
            s, index = state[cell], (index << n) + place[cell]
        at[index] = point
    assert sorted(at) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def test_column_form_visits_every_cell_once(spark):
    grid = spark.createDataFrame(list(itertools.product(range(4), repeat=3)), "a int, b int, c int")
    got = grid.select(hilbert_index([grid.a, grid.b, grid.c], 2).alias("h"), "a", "b", "c").orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:])) == 1 for p, q in zip(got, got[1:]))


def test_rows_law_slots_and_sizes(spark):
    docs = cases.table(spark)
    out = hilbert_shards(docs, 5).collect()
    assert len(out) == len(cases.rows())
    counts = [sum(r["shard"] == s for r in out) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    texts = {}
    for row in cases.rows():
        texts.setdefault(row[0], set()).add(row[1] or "")
    for r in out:
        assert (r["size"], r["text_crc32"]) in {(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]}
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_copies_stand_together(spark):
    rows = [(i, f"text {i % 7}", "en", f"s{i % 3}", 6) for i in range(70)]
    out = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 4)
    order = [r["text_crc32"] for r in out.orderBy("shard", "slot").collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) == 6


def test_fewer_rows_than_shards_and_empty(spark):
    few = spark.createDataFrame([(1, None, None, None), (2, "a", "x", "y")], "doc_id long, text string, lang string, source string")
    got = hilbert_shards(few, 24).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == 2
    assert hilbert_shards(cases.empty(spark)).count() == 0
