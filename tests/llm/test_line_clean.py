import re
from collections import Counter

import llm_cases as cases
from febrile.llm.line_clean import clean_lines

WORD = r"[^\x20\x09-\x0D]+"


def expected(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_base_counts_match_brute_force(spark):
    out = clean_lines(cases.table(spark)).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out.count() == len(cases.rows())
    for r in out.collect():
        assert tuple(r)[1:] == expected(r["text"])


def test_columns_pass_through_and_are_replaced(spark):
    out = clean_lines(cases.table(spark))
    assert {"doc_id", "score", "block", "n", "kept"} <= set(out.columns) and dict(out.dtypes)["kept"] == "boolean"
    assert clean_lines(cases.empty(spark)).count() == 0


def test_line_rules(spark):
    prose = "The quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight."
    texts = [f"{prose}\nHome | About | News | Contact | Help\n{prose[::-1]}",
             "\n".join(["BUY!! NOW!! CHEAP!! GOODS!! HERE!!"] * 3 + ["FREE!! STUFF!! FOR!! ALL!! OF!! YOU!!"]) + "\nok ok",
             "\n".join([prose] + ["All rights reserved."]), "go go go go go go go go go go go go go go go go go go go go go go go stop"]
    got = {r["text"]: r for r in clean_lines(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got[texts[0]]["kept"] and "About" not in got[texts[0]]["clean_text"] and got[texts[0]]["n_lines_removed"] == 1
    assert not got[texts[1]]["kept"] and got[texts[1]]["clean_text"] == "ok ok"
    assert got[texts[2]]["clean_text"] == prose
    assert not got[texts[3]]["kept"]


def test_clean_documents_stay_and_junk_goes(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").join(spark.read.parquet(f"{SF_SMALL}/labels.parquet"), "doc_id")
    out = clean_lines(docs).filter("not base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    assert {r["quality"] for r in out} <= {0, 1}
    kept = clean_lines(docs).filter("not base_failed and quality = 1")
    assert kept.filter("not kept").count() == 0


def test_native_plan(spark):
    plan = clean_lines(cases.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_a_line_is_lowered_once(spark):
    docs = spark.createDataFrame([(1, "All Rights Reserved\nplain words")], "doc_id long, text string")
    plan = clean_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2  # once for the lines and, where the optimiser repeats the projection, once more
