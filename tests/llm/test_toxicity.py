import random

import llm_cases as cases
from febrile.llm.toxicity import FoldTable, ToxicityModel, automaton, fold, held_out, hits, learn, score


def test_folding_undoes_substitutions():
    t = FoldTable()
    for s in ("idiot", "IDIOT", "1d10t", "іdіоt", "ïdîöt", "i​diot", "ｉｄｉｏｔ", "!diot", "id!ot"):
        assert fold(s, t).split()[-1].endswith("diot"), s
    assert fold("1d10t", t) == " idiot " and fold("id!ot", t) == " idiot "
    assert fold("a1b2 c-d.", t).split() == ["aib", "c", "d"]


def test_longest_weight_and_exceptions():
    model = ToxicityModel({" low": 1.0, " lowest": 3.0, " scum ": 2.0}, ["lowest price"])
    m, t = automaton(model), FoldTable()
    assert hits(fold("the lowest lower scum scummy", t), m) == {4: 3.0, 11: 1.0, 17: 2.0}
    assert hits(fold("the lowest price", t), m) == {}
    assert hits(fold("anything", t), automaton(ToxicityModel())) == {}


def corpus(n=400):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        w = cases.words(1000 + i, 40)
        y = int(i % 4 == 0)
        if y:
            w[rnd.randrange(40)] = rnd.choice(["zogwart", "zogwarts", "Z0gw4rt!", "blimfen", "BLIMFEN"])
        elif i % 40 == 1:
            w[10:12] = ["blimfen", "tea"]
        rows.append((i, " ".join(w), y))
    return rows


def test_learned_lexicon_separates_and_spares_exceptions(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    model = learn(df.filter("doc_id < 300").select("text", "toxic"))
    assert any(e.strip().startswith("zog") for e in model.weights) and "blimfen tea" in model.exceptions
    out = score(df, model)
    wrong = out.filter("(score >= 0.7) <> (toxic = 1)")
    assert wrong.count() <= 2
    assert out.filter("score < 0 or score > 1").count() == 0


def test_scores_do_not_depend_on_ids_or_labels(spark):
    model = learn(spark.createDataFrame(corpus(), "doc_id long, text string, toxic int").select("text", "toxic"))
    a = spark.createDataFrame([(1, "a zogwart here", 0, "en"), (2, "a zogwart here", 1, "de")], "doc_id long, text string, toxic int, lang string")
    assert len({r["score"] for r in score(a, model).collect()}) == 1


def test_odd_rows(spark):
    model = learn(spark.createDataFrame(corpus(), "doc_id long, text string, toxic int").select("text", "toxic"))
    out = score(cases.table(spark), model)
    assert out.count() == len(cases.rows()) and dict(out.dtypes)["score"] == "double"
    blank = {r["score"] for r in out.filter("trim(coalesce(text, '')) = ''").collect()}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert score(cases.empty(spark), model).count() == 0
    none = learn(spark.createDataFrame([], "text string, toxic int"))
    assert none.weights == {} and score(cases.table(spark), none).filter("score > 0.01").count() == 0
    same = learn(spark.createDataFrame([("a", 1), ("b", None), (None, 1)], "text string, toxic int"))
    assert same.weights == {}


def test_held_out_rule(spark):
    import zlib
    from pyspark.sql import functions as F
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_held_out_accuracy_on_the_tables(spark):
    from febrile.llm.toxicity import op10_toxicity
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    out = op10_toxicity(spark, d).join(labels, "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.02 * n[(0, 0)] and n[(1, 1)] >= 0.7 * (n[(1, 1)] + n.get((1, 0), 0))


def test_signs_at_edges_are_read_both_ways():
    t = FoldTable()
    for s, word in (("$cum", "scum"), ("!diot", "idiot"), ("a$$", "ass"), ("id@@t", "idaat"), ("!idiot", "idiot"), ("idiot!", "idiot"), ("$tup!d", "stupid")):
        assert word in fold(s, t).split(), s
    assert fold("a | b|c $5", t).split() == ["a", "blc", "s"]


def naive_hits(folded, weights, exceptions):
    at = {}
    for i in range(len(folded)):
        for entry, w in weights.items():
            if folded.startswith(entry, i):
                at[i] = max(w, at.get(i, 0.0))
    for phrase in exceptions:
        for i in range(len(folded)):
            if folded.startswith(f" {phrase} ", i):
                for start in [x for x in at if i <= x < i + len(phrase) + 1]:
                    del at[start]
    return at


def test_automaton_finds_what_a_scan_finds():
    rnd, t = random.Random(5), FoldTable()
    stems = ["abc", "abcab", "bca", "cabca", "aab"]
    for _ in range(200):
        weights = {f" {s}{rnd.choice(['', ' '])}": round(rnd.uniform(0.5, 4), 3) for s in rnd.sample(stems, 3)}
        model = ToxicityModel(weights, [f"{rnd.choice(stems)} {rnd.choice(stems)}" for _ in range(2)])
        text = " ".join(rnd.choice(stems) + rnd.choice(["", "", "b", "ca"]) for _ in range(30))
        folded = fold(text, t)
        assert hits(folded, automaton(model)) == naive_hits(folded, model.weights, model.exceptions)


def test_plain_english_scores_low(spark):
    from febrile.llm.toxicity import learned_from
    model = learned_from(spark, "/root/testdata/sf0.01")
    assert all(len(e.strip()) >= 5 for e in model.weights if not e.endswith(" "))
    texts = ["We had more discussion about clouds this morning.", "The committee will discuss the moral question tomorrow.",
             "The distance to the closest idiom dictionary is moderate."]
    out = score(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    assert out.filter("score >= 0.5").count() == 0
    bad = score(spark.createDataFrame([("what a pathetic mor0n",), ("He is worthle$$, !diot.",)], "text string"), model)
    assert bad.filter("score < 0.7").count() == 0


def test_copies_teach_once_and_beginnings_need_two_words(spark):
    rows = corpus()
    group = " ".join(f"unique{format(i, 'x')}" for i in range(60))
    copies = [(1000 + i, f"{group} zogwart {cases.words(i, 3)}", 1) for i in range(60)]
    model = learn(spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int").select("text", "toxic"))
    assert not any(e.strip().startswith("unique") for e in model.weights)
    assert not any(e.startswith(" blimf") and not e.endswith(" ") for e in model.weights)
    assert " zogwart" in model.weights                 # zogwart and zogwarts share it


def test_of_several_labels_the_toxic_one_counts(spark, tmp_path):
    from febrile.llm.toxicity import learned_from
    rows = corpus()
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    once = [(i, y) for i, _, y in rows]
    again = [(i, 0) for i, _, _ in rows] + once          # conflicting and repeated labels
    models = []
    for labels in (once, again):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        models.append(learned_from(spark, str(tmp_path)))
    assert models[0] == models[1] and models[0].weights
