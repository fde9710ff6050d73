"""The pipeline and the registered queries against plain versions on the smallest tables."""

import math

import duckdb
import pytest

import corpus_pipeline as P
import llm_cases as cases
from conftest import SF_SMALL
from febrile.llm.queries import oracle_sql, queries

TABLES = "documents benchmark labels pages embeddings".split()
ORACLE = oracle_sql()


def norm(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries()[name](spark, SF_SMALL)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_names_and_registration():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "token_id_output"]


def plain_pipeline(spark, sf_dir):
    """The same decisions in plain Python, but for the toxicity model, which is the operator's own."""
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from febrile.llm.token_frames import tokenizer_file
    docs = P.drop_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).toPandas()
    sets, keep = [], {}
    for r in docs.sort_values("doc_id").itertuples():
        w = r.text.encode().lower().split()
        s = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        near = [i for i, t in sets if s and 100 * len(s & t) >= 80 * len(s | t)]
        keep[r.doc_id] = not near     # a smaller id that is linked, itself or through others, holds the group
        sets.append((r.doc_id, s))
    docs = docs[docs.doc_id.map(keep)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = set()
    for t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas().text:
        w = low(t)
        windows |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for r in docs.itertuples():
        w, hit = low(r.text), set()
        for k in range(len(w)):
            if tuple(w[k:k + 13]) in windows:
                hit.update(range(k, min(k + 13, len(w))))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((r.doc_id, r.text))
    tok = Tokenizer.from_file(tokenizer_file())
    out = {}
    for i, t in clean:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        out[i] = (len(ids), zlib.crc32(ids.tobytes()))
    return out


def test_pipeline_matches_plain_version(spark):
    got = P.run(spark, SF_SMALL).orderBy("start").collect()
    want = plain_pipeline(spark, SF_SMALL)
    assert {r["doc_id"] for r in got} == set(want)
    assert all((r["n_tokens"], r["ids_crc32"]) == want[r["doc_id"]] for r in got)
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    reads = {}
    for r in got:
        reads[r["doc_id"]] = reads.get(r["doc_id"], 0) + 1
    assert max(reads.values()) <= math.ceil(P.REPETITION) and max(reads.values()) >= 1


def test_stages_take_odd_rows_and_keep_columns(spark):
    docs = cases.table(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        docs = P.written(out, "test-stage")
        assert docs.filter("text is null or text = ''").count() >= 2, name
    assert docs.filter("doc_id in (1, 2)").count() == 0          # copies and near copies of 0
    assert P.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
    none = cases.empty(spark)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0, name


def test_near_copies_are_judged_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b + " more"), (7, None), (7, ""), (11, c), (11, c.upper()), (11, c), (12, c), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SF_SMALL).collect()]
    kept = [g for g in got if g[0] == 11]
    assert len(kept) == 1 and kept[0][1].lower() == c
    assert sorted((g for g in got if g[0] != 11), key=repr) == sorted([(3, a), (5, b), (7, None), (7, ""), (None, a)], key=repr)
