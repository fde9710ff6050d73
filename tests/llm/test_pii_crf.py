import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import llm_cases as cases
from febrile.llm.pii_crf import Decoder, Field, TOKEN, base_spans, find_personal_data, labelled_table, merged, shape, train, viterbi, word_places

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def expected(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.-@+ ()%_2345é.9\n", max_size=40))
def test_base_spans_follow_the_patterns(text):
    assert base_spans(text) == expected(text)


def test_long_texts_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 100_000, "1 " * 100_000):
        base_spans(t)


def test_viterbi_matches_trying_all_paths():
    rnd = np.random.default_rng(3)
    em, trans, lengths = rnd.normal(size=(6, 4, 3)), rnd.normal(size=(3, 3)), np.array([1, 2, 3, 4, 4, 2])
    got = viterbi(em, lengths, trans)
    for b, n in enumerate(lengths):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(em[b, t, y] for t, y in enumerate(p)) + sum(trans[a, c] for a, c in zip(p, p[1:])))
        assert tuple(got[b, :n]) == best


def test_skipping_settled_lines_changes_nothing(spark):
    field = train(labelled_table(spark))
    d = Decoder(field)
    lines = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    fast = d.spans(lines)
    d.gain = d.gain + 1e6     # no line is settled by the bound any more
    assert d.spans(lines) == fast


def test_held_out_lines(spark):
    """Names, numbers and spelled addresses that the labelled table does not hold."""
    d = Decoder(train(labelled_table(spark)))
    cases_in = {
        "Please ask for Mr. Petersen at noon.": ("name", "Petersen"),
        "my name is Olga Brandt": ("name", "Olga Brandt"),
        "Phone: 555-9876": ("local_phone", "555-9876"),
        "SSN: 321-54-9876": ("id_number", "321-54-9876"),
        "write to maria at postbox dot com for more": ("spelled_email", "maria at postbox dot com"),
    }
    for text, want in cases_in.items():
        assert [(k, text[s:e]) for k, s, e in d.spans([text])[0]] == [want], text
    rnd = random.Random(1)
    prose = [" ".join(rnd.choice(["The", "of", "Anhash", "thering", "is.", "To", "la", "er,", "12", "Onble"]) for _ in range(30)) for _ in range(200)]
    assert sum(map(len, d.spans(prose))) <= 4


def test_base_spans_stay_and_others_give_way():
    assert merged([("card", 5, 25)], [("name", 20, 30), ("name", 30, 33)]) == [("card", 5, 25), ("name", 30, 33)]
    assert shape("O'Neil") == "XXxx" and shape("123-45-6789") == "ddd-dd-dddd" and shape("Ab" * 300) == "Xx" * 300


def test_odd_rows(spark):
    out = find_personal_data(cases.table(spark).withColumnRenamed("score", "spans"))
    assert out.count() == len(cases.rows()) and {"doc_id", "block", "spans"} <= set(out.columns)
    for r in out.collect():
        want = expected(r["text"] or "")
        assert r["base_spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in want) and r["n_card"] == sum(k == "card" for k, _, _ in want)
    assert find_personal_data(cases.empty(spark)).count() == 0
    none = spark.createDataFrame([], "tokens array<string>, labels array<string>")
    one = spark.createDataFrame([("mail a@b.cd to Mr. Xavier",)], "text string")
    r = find_personal_data(one, none).first()
    assert r["spans"] == r["base_spans"] == "email:5:11"
    assert isinstance(train(labelled_table(spark).limit(30)), Field)


#: Labelled lines with names, numbers and keys that the labelled table does not hold.  Many of their sentence frames
#: ("You can reach me on", "Signed,", "I am ..., the manager.") are in it, so this measures new fillers, not new sentences.
HELD_OUT = [
    ("Her SSN is <123-45-6780>, she said.", "id_number"), ("My SSN is <555-12-9876> I think", "id_number"), ("Passport: <L8273645>", "id_number"),
    ("You can reach me on <020 7946 0958>.", "local_phone"), ("My phone number is <415-555-0132>.", "local_phone"), ("Call me at <0171 555 0777> or come", "local_phone"),
    ("tel. <(312) 555-0188> today", "local_phone"), ("Phone: <555-9876>", "local_phone"),
    ("Email me at <jane dot doe at gmail dot com>", "spelled_email"), ("write to <maria at postbox dot com> for more", "spelled_email"),
    ("mail <peter at lowland dot net> please", "spelled_email"),
    ("Signed, <Maria Lopez>", "name"), ("I am <Thomas Becker>, the manager.", "name"), ("My name is <John O'Neil>", "name"),
    ("Please ask for Mr. <Petersen> at noon.", "name"), ("my name is <Olga Brandt>.", "name"), ("Regards, <Victor Hansen>", "name"),
    ("Name: <Agnes Moreau>", "name"), ("We saw Dr. <Pavel Novotny> there.", "name"),
    ('token = "<04dbebab91ab85687d33eeaaf9ac699e1188f962>" thhantou', "secret"), ('TOKEN = "<9233A8ECF7C5B09FE5949719B6B82BC439E9329B>"!!', "secret"),
    ("api_key: <sk9aZ81hdu72hd81hs>", "secret"), ("password = <q7Rt55xLp0nMm2Vw9z>", "secret"),
    ("We met in Bond Street.", None), ("He lives in Bond Street, near Hyde Park.", None), ("It was 1984 in Paris.", None), ("Die Die Die Die Die Die Die.", None),
    ("commit 7b1e9f0c22aa41d8b6d3e5f7a9c1b3d5e7f90123 broke it", None), ("Order 7731-20 holds 12 boxes at 3,50 each.", None), ("the house dot by the road", None),
    ("The Anders road and the Brook are long.", None), ("Chapter 31 on page 202 tells of Marlow.", None), ("I am here. The Grand Hotel is there.", None),
]


def test_held_out_precision_and_recall_by_kind(spark):
    d = Decoder(train(labelled_table(spark)))
    found, right, wanted = {}, {}, {}
    for marked, kind in HELD_OUT:
        text = marked.replace("<", "").replace(">", "")
        want = [(kind, marked.index("<"), marked.index(">") - 1)] if kind else []
        got = d.spans([text])[0]
        for k, _, _ in want:
            wanted[k] = wanted.get(k, 0) + 1
        for x in got:
            found[x[0]] = found.get(x[0], 0) + 1
            right[x[0]] = right.get(x[0], 0) + (x in want)
    for kind, n in wanted.items():
        assert right.get(kind, 0) >= 0.8 * n, (kind, "recall", right, wanted)
        assert right.get(kind, 0) >= 0.8 * found.get(kind, 0), (kind, "precision", right, found)


def test_secrets_of_the_tables_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = find_personal_data(docs).collect()
    planted = [r for r in rows if re.search(r'(?i)token = "[0-9a-f]{40}"', r["text"] or "")]
    assert planted and all("secret:" in r["spans"] for r in planted)
    more = sum(1 for r in rows if r["spans"] != r["base_spans"])
    assert more <= len(planted) + 0.01 * len(rows)


def test_one_very_long_line_and_one_very_long_word(spark):
    d = Decoder(train(labelled_table(spark)))
    prose = "the river and the road were long and old " * 20_000
    text = f"{prose}my name is Olga Brandt and I live here. {prose}"
    assert d.spans([text])[0] == [("name", len(prose) + 11, len(prose) + 22)]
    for odd in ("x" * 300_000, "a!" * 100_000, "!" * 300_000, "aB1" * 100_000, "'" * 100_000, "a" + "-" * 200_000):
        assert isinstance(d.spans([odd])[0], list)


def test_words_around_signs():
    lines = [["SSN", ":", '"', "12"], ["!!"], ["a", "b"]]
    word = np.array([t[0].isalnum() for x in lines for t in x])
    first = np.array([k == 0 for x in lines for k, _ in enumerate(x)])
    before, after = word_places(word, first)
    assert before.tolist() == [-1, 0, 0, 0, -1, -1, 5] and after.tolist() == [3, 3, 3, -1, -1, 6, -1]
    assert TOKEN.findall('token="ab1", (x.y) O\'Neil!!') == ["token", '="', "ab1", '",', "(", "x.y", ")", "O'Neil", "!!"]
