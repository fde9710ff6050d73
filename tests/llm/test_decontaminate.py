import re

import llm_cases as cases
from febrile.llm.decontaminate import contamination, windows_of, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(text, items):
    w = WORD.findall(lower(text))
    hit, owners = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s:s + n] == v[k:k + n]:
                    hit.update(range(s, s + n))
                    owners.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(owners), bool(hit) and 20 * len(hit) >= len(w)


def test_words_follow_the_contract():
    for t in ("A-b_C 1,2 Éa ÄÖ\x7fz", "İstanbul ß\x00x", "", None, "tab\tnew\nline"):
        assert words_of(t) == [x.encode() for x in WORD.findall(lower(t))]
    assert len(windows_of(words_of("a b c"))) == 1 and len(windows_of(words_of(" ".join(map(str, range(15)))))) == 3


def test_hits_match_brute_force(spark):
    base = cases.words(1, 120)
    items = [(1, " ".join(base[10:40])), (2, "one two"), (3, ""), (4, None), (5, " ".join(base[100:110])), (6, " ".join(base[20:33])),
             (6, "Zeile zwei"), (None, "lonely text"), (7, "aaaaaaa"), (8, "abc abc abc")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (16 << 20, 600):   # one block, several blocks
        out = contamination(cases.table(spark), bench, block_bytes)
        rows = out.select("text", "n_words", "n_hit", "item_ids", "contaminated", "n_items").collect()
        assert len(rows) == len(cases.rows())
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == expected(r["text"], items)
            assert r["n_items"] == len(r["item_ids"])


def test_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = contamination(cases.table(spark), bench)
    assert out.count() == len(cases.rows()) and out.filter("contaminated or n_hit > 0").count() == 0
    one = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert contamination(cases.empty(spark), one).count() == 0
