import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from febrile.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score string, window string, i string, j string"


def brute(rows, p=H.MineParams()):
    """Anchors (ids divisible by 100) against all rows; repeated rows count once."""
    held = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held[vec_id] = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vec])
    out = []
    for a, (own, va) in held.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb, strict=False)), b, lab) for b, (lab, vb) in held.items() if b != a)
        for less, pos in [(s, b) for s, b, lab in scored if lab == own][:p.positives]:
            fits = [(s, b) for s, b, lab in scored if lab != own and 80 * -less <= 100 * -s <= 100 * -less][:p.negatives]
            out += [(a, pos, r + 1, b, -less, -s) for r, (s, b) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, p=H.MineParams()):
    table = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = H.mine(H.usable(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0, p)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim=20, labels=3):
    rnd = random.Random(seed)
    center = [rnd.uniform(0, 1) for _ in range(dim)]
    return [(i, [c + rnd.uniform(-.2, .2) for c in center], rnd.randrange(labels), "a", "s", "w", "i", "j") for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 4), (70, 64, 33), (65, 70, 129)])
def test_product_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (H.strassen(a, b, 2) == a @ b).all() and (H.strassen(a, b, 32) == a @ b).all()
    big = a * (1 << 40)  # past the doubles: leaves multiply whole numbers, modulo 2^64
    assert (H.strassen(big, b << 10, 2) == big @ (b << 10)).all()


def test_same_as_brute_force_over_many_cells(spark):
    rows = vectors(1, 600)
    small = H.MineParams(anchor_block=2, row_block=60, leaf=4)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, small) == want and mined(spark, rows) == want


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = vectors(2, 250, dim=6)
    same = [0.5] * 6
    rows += [(1000 + i, same, i % 2, None, None, None, None, None) for i in range(120)]     # one vector many times
    rows += [rows[3], rows[100], rows[-1]]                                                   # repeated rows
    rows += [(2000, None, 1, *"aswij"), (2001, same, None, *"aswij"), (2002, [0.5, None], 1, *"aswij"), (2100, [float("nan")] * 6, 1, *"aswij"),
             (2200, [float("inf")] * 6, 1, *"aswij"), (None, same, 1, *"aswij"), (2300, [], 1, *"aswij"), (2301, [0.9], 1, *"aswij"),
             (2302, same + [0.25] * 40, 0, *"aswij")]
    want = brute(rows)
    assert mined(spark, rows, H.MineParams(anchor_block=3, row_block=50, leaf=2)) == want
    assert {r[0] for r in want} >= {0, 1100}


def test_empty_single_label_and_too_large(spark):
    assert mined(spark, []) == []
    assert mined(spark, [r for r in vectors(3, 300) if r[0] % 100]) == []         # no anchor
    one = [(7 * k + 1, [0.5, 0.5], 4, *"aswij") for k in range(50)] + [(100, [0.5, 0.5], 4, *"aswij")]
    assert mined(spark, one) == []                                                  # no other label
    with pytest.raises(Exception, match="too large|leave 64 bits"):
        mined(spark, [(100, [1e30], 1, *"aswij"), (101, [1.0], 1, *"aswij")])


def test_heaps_take_the_best_once_each():
    heaps = H.Heaps(2, 3)
    heaps.offer(np.array([0, 0, 1, 0, 0]), np.array([5, 7, 1, 5, 5]), np.array([9, 4, 2, 9, 3]))
    heaps.offer(np.array([0]), np.array([6]), np.array([9]))
    heap, score, name = heaps.entries()
    assert list(zip(heap.tolist(), score.tolist(), name.tolist())) == [(0, 7, 4), (0, 6, 9), (0, 5, 3), (1, 1, 2)]
