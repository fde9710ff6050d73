import random

import numpy as np
import pytest

import llm_cases as cases
from febrile.llm.suffix_dedup import PrefixHash, _padded, _sliding_min, blocks_of, common_extension, equal_runs, remove_repeats, suffix_order


def expected(docs, length):
    """Removed bytes of each (id, text) in order, by comparing every string with all earlier ones."""
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        own = []
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = [True] * length
            seen.add(w)
            own.append(w)
        out[key] = (len(raw), bytes(b for b, g in zip(raw, gone) if not g),
                    sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
    return out


def check(spark, docs, length=100):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in remove_repeats(df, length).collect()}
    assert got == expected(sorted(docs), length)


def test_common_extension_and_order_match_plain_sorting():
    rnd = random.Random(4)
    raw = bytes(rnd.choice(b"ab") for _ in range(600)) * 2 + bytes(rnd.choice(b"abcdef") for _ in range(400)) + b"z" * 40
    data = np.frombuffer(raw, np.uint8)
    h = PrefixHash(data)
    starts = np.array(rnd.sample(range(len(raw) - 30), 500))
    a, b = starts[:250], starts[250:]
    for x, y, n in zip(a, b, common_extension(h, a, b, 30)):
        k = 0
        while k < 30 and raw[x + k] == raw[y + k]:
            k += 1
        assert n == k
    order = suffix_order(data, h, starts, 30)
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: (raw[s:s + 30], s))
    run = equal_runs(data, h, order, 30)
    assert [i == j for i, j in zip(run, run[1:])] == [raw[s:s + 30] == raw[t:t + 30] for s, t in zip(order, order[1:])]


def test_blocks_cover_every_start_once_and_share_grams():
    rnd = random.Random(5)
    raw = bytes(rnd.choice(b"abcdefgh ") for _ in range(3000))
    gram, start, n, spot, twice = blocks_of(np.frombuffer(raw + raw[500:900], np.uint8))
    assert np.concatenate([np.arange(s, s + c) for s, c in zip(start, n)]).tolist() == list(range(3400 - 99))
    owner = {s + i: g for s, c, g in zip(start, n, gram) for i in range(c)}
    assert all(owner[500 + i] == owner[3000 + i] for i in range(300))
    assert (spot >= n - 1).all() and (spot <= 68).all()
    assert _sliding_min(np.array([5, 3, 4, 1, 9, 9, 9], np.uint64), 3).tolist() == [3, 1, 1, 1, 9]
    assert _padded(b"abcdef", -2, 4) == b"\0\0ab" and _padded(b"abcdef", 4, 4) == b"ef\0\0"


def test_copies_passages_periods_and_overlaps(spark):
    base = cases.words(7, 300)
    passage = " ".join(cases.words(8, 40))
    docs = [(10, " ".join(base)), (3, " ".join(base)), (4, "x " + " ".join(base[40:90]) + " y"), (5, passage), (6, "left " + passage + " right"),
            (7, passage + passage), (8, "ab" * 200), (9, "a" * 99), (11, "a" * 150), (12, None), (13, ""), (14, "ä" * 120),
            (15, "Orre " * 100 + passage[:110]), (16, "Orre " * 30), (17, passage[5:130] + "tail" + passage[20:140])]
    check(spark, docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies(spark, seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcde ") for _ in range(900))
    docs = []
    for i in range(40):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(t))
            t[at:at + rnd.randrange(3)] = rnd.choice(["", "Q", "ZZ"])
        lo = rnd.randrange(300)
        docs.append((i, "".join(t)[lo:lo + rnd.randrange(90, 700)]))
    check(spark, docs)


def test_repeated_rows_of_near_copies_are_one_document(spark):
    base = cases.words(9, 200)
    near = base[:]
    for at in range(0, 200, 25):
        near[at] = f"changed{at}"
    period = "Orre " * 60  # its blocks hold their gram twice: cut into single strings
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, period + " ".join(near[100:])), (4, "left " + period)]
    want = expected(docs, 100)
    for rows in (docs + docs[1:3], docs * 3):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
        assert len(got) == len(rows)
        assert all((r["n_bytes"], bytes(r["kept"]), len(r["spans"])) == want[r["doc_id"]] for r in got)


def test_odd_rows(spark):
    rows = cases.rows()
    got = remove_repeats(cases.table(spark)).collect()
    assert len(got) == len(rows)
    # rows without an id come first, exact repeats are one document
    ordered = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})
    assert sum(r["doc_id"] is None for r in got) == 2
    lonely = [r for r in got if r["doc_id"] is None and r["n_bytes"] < 100]
    assert bytes(lonely[0]["kept"]) == b"lonely text without an id"
    total = {r["n_bytes"]: bytes(r["kept"]) for r in got if r["doc_id"] == 0}
    assert list(total.values()) == [b""] and ordered[0][0] == -1     # the copy without an id stands before it
    assert remove_repeats(cases.empty(spark)).count() == 0


def test_powers_are_made_once_and_hashes_and_minima_stay():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, n).astype(np.uint8) for n in (700, 900))
    assert np.shares_memory(PrefixHash(a).back, PrefixHash(b).back)
    h = PrefixHash(b)
    assert np.array_equal(h.all(32), h.of(np.arange(len(b) - 31), 32))
    for w in (1, 2, 3, 69, 70, 128, 900):
        assert _sliding_min(b, w).tolist() == [b[k:k + w].min() for k in range(len(b) - w + 1)]


def test_the_sort_compares_only_suffixes_with_equal_first_bytes(monkeypatch):
    from febrile.llm import suffix_dedup as S
    asked, real = [], S.common_extension
    monkeypatch.setattr(S, "common_extension", lambda h, a, b, most: asked.append((a, b)) or real(h, a, b, most))
    rnd = np.random.default_rng(8)
    data = rnd.integers(97, 123, 4_000).astype(np.uint8)
    data = np.concatenate([data, data[:300], data[:300], np.full(200, 97, np.uint8)])
    raw, starts = data.tobytes(), rnd.permutation(len(data) - 60)
    order = suffix_order(data, PrefixHash(data), starts, 60)
    assert order.tolist() == sorted(range(len(data) - 60), key=lambda s: (raw[s:s + 60], s))
    a, b = (np.concatenate(x) for x in zip(*asked))
    assert all(raw[x:x + 8] == raw[y:y + 8] for x, y in zip(a.tolist(), b.tolist()))
    # some 1,000 of 4,740 suffixes share their first bytes, nearly all with two others: two levels of few steps, not thirteen of many
    assert len(asked) < 60
    assert suffix_order(data, PrefixHash(data), np.zeros(0, np.int64), 60).tolist() == []


def test_the_search_goes_through_long_data_in_small_pieces(monkeypatch):
    from febrile.llm import suffix_dedup as S
    sizes, real = [], S.PrefixHash
    monkeypatch.setattr(S, "PrefixHash", lambda data: sizes.append(len(data)) or real(data))
    data = np.random.default_rng(9).integers(0, 256, 300_000).astype(np.uint8)
    gram, start, n, _, _ = blocks_of(data, ends=np.array([100_000, 300_000]))
    assert max(sizes) <= 1 << 17 and sum(n) == 100_000 - 99 + 200_000 - 99 and len(gram) == len(start)
