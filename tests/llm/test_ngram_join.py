import random

import numpy as np

import llm_cases as cases
from febrile.llm.components import components
from febrile.llm.ngram_join import JoinParams, Shingler, choose_bands, ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def expected(rows):
    """id -> (class, set, links, class links) by comparing all sets."""
    sets = {}
    for i, t in rows:
        if shingles(t):
            sets.setdefault(shingles(t), []).append(i)
    reps = list(sets)
    near = {a: [b for b in reps if a is not b and 100 * len(a & b) >= 80 * len(a | b)] for a in reps}
    out = {}
    for a in reps:
        part, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in part:
                    part.add(b)
                    todo.append(b)
        for i in sets[a]:
            out[i] = (min(min(sets[b]) for b in part), min(sets[a]), sum(len(sets[b]) for b in near[a]) + len(sets[a]) - 1, len(near[a]))
    return out


def check(spark, rows, params=JoinParams()):
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), params).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want.get(r["doc_id"], (r["doc_id"], r["doc_id"], 0, 0))


def test_bands_reach_the_recall():
    bands, rows = choose_bands(JoinParams())
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 200


def test_shingle_sets():
    s = Shingler(5)
    assert len(s.set_of("a b c d e f")) == 2 and len(s.set_of("a b")) == 1 and len(s.set_of(" \n")) == 0
    assert s.set_of("A b\nC d E").tolist() == s.set_of("a B c D e").tolist()
    assert s.set_of("a b").tolist() != s.set_of("a b b").tolist()


def family(seed, copies, length=60, edits=3):
    rnd = random.Random(seed)
    base = cases.words(seed, length, 5000)
    out = []
    for _ in range(copies):
        t = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            t[rnd.randrange(length)] = f"e{rnd.randrange(3)}"
        out.append(" ".join(t))
    return out


def test_links_and_classes_match_brute_force(spark):
    texts = family(1, 30, 80) + family(2, 8) + family(3, 2, 6) + [" ".join(cases.words(k, 50, 9000)) for k in range(50, 70)]
    rows = list(enumerate(texts + ["", None, " \t", "one", "ONE", "two words", None]))
    random.Random(0).shuffle(rows)
    check(spark, rows)


def test_large_group_is_cut_into_blocks(spark):
    rows = list(enumerate(family(5, 70, 60, 4)))
    check(spark, rows, JoinParams(block_docs=10))
    check(spark, rows, JoinParams(block_docs=1000, block_shingles=300))


def test_long_near_copies_leave_blocks_empty(spark):
    # more blocks than classes: pairs of a block with an empty one hold one block's rows only
    check(spark, list(enumerate(family(6, 2, 400, 4))), JoinParams(block_shingles=60))
    check(spark, list(enumerate(family(7, 5, 300, 4))), JoinParams(block_shingles=100))


def test_odd_rows(spark):
    got = ngram_join(cases.table(spark)).collect()
    rows = cases.rows()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["class_id"] == by[1][0]["class_id"] == 0
    assert by[2][0]["class_id"] == 0 and len(by[2]) == 2 and by[2][0]["set_id"] == 2
    assert sorted((r["class_id"] is None, r["n_links"] > 0) for r in by[None]) == [(False, True), (True, False)]
    assert by[3][0]["class_id"] == 3 and by[3][0]["n_links"] == 0
    assert ngram_join(cases.empty(spark)).count() == 0


def test_an_id_with_several_texts_does_not_fail(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n")]
    assert ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_an_id_with_several_texts_stands_in_the_class_of_each(spark):
    a, b, c = (" ".join(cases.words(k, 60, 9000)) for k in (31, 32, 33))
    near = " ".join(b.split()[:-2] + ["other", "end"])
    rows = sorted([(5, a), (5, b), (7, a), (9, b), (12, b), (20, near), (21, c), (21, "short"), (22, c), (5, a)])
    want = expected(list(enumerate(t for _, t in rows)))
    ids = [i for i, _ in rows]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, ids[want[k][0]], ids[want[k][1]], *want[k][2:]) for k, i in enumerate(ids))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(30)] + [(100, 101 + k) for k in range(20)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_signatures_estimate_similarity():
    from febrile.llm.common import mix64
    from febrile.llm.ngram_join import _signature
    base = np.arange(4000, dtype=np.uint64)
    a, b = mix64(base) | np.uint64(1), mix64(base + np.uint64(1 << 60))
    x, y = mix64(np.arange(1000, dtype=np.uint64)), mix64(np.arange(100, 1100, dtype=np.uint64))
    share = (_signature(x, a, b) == _signature(y, a, b)).mean()
    assert abs(share - 900 / 1100) < 0.03
