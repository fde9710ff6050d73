import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

import llm_cases as C
from febrile.llm import piece_codec as P
from febrile.llm.queries import queries

MODEL = P.PieceModel(P.model_file())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.model_file())


def encoded(texts, encoder=None):
    ids, counts = (encoder or P.Encoder(MODEL)).encode(texts)
    out, at = [], 0
    for c in counts.tolist():
        out.append(ids[at:at + c].tolist())
        at += c
    return out


ODD = ["", " ", "  ", "a", "  a b ", " " * 100, " " * 17 + "x", "x" + " " * 33 + "y", "\n\n a", "héllo wörld", "日本語 😀", "a▁b", "▁▁ ▁", "aaaa" * 700,
       "0123 45.6", "\x00x", "a\tb\r\n", "́e", "||||====----", "ﬁ", "<s></s><unk><0x0A>", "(x).\n\n(y)", "...!!!???", "=" * 5000, "İiİ"]


def test_odd_texts_as_the_library_does():
    assert encoded(ODD) == [LIBRARY.encode(t, add_eos=True) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabbccdeet  hinrso\n'.-=0é▁日😀")), max_size=60), max_size=4))
def test_any_text_as_the_library_does(texts):
    assert encoded(texts) == [LIBRARY.encode(t, add_eos=True) for t in texts]


def test_long_texts_and_a_small_memory():
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdeghilnorst") for _ in range(rnd.randrange(1, 14))) for _ in range(20_000)), "ab" * 30_000, " " * 3_000]
    small = P.Encoder(MODEL, limit=10_000)
    for _ in range(2):  # the second time after forgetting
        assert encoded(texts, small) == [LIBRARY.encode(t, add_eos=True) for t in texts]


def test_words_with_equal_scores_go_one_merge_at_a_time():
    for n in range(1, 70):
        word = P.BLANK * n + "x"
        symbols, counts = P.merge_rounds(MODEL, [word, "the"])
        assert symbols[:counts[0]].tolist() == P.one_at_a_time(MODEL, word) == LIBRARY.encode(" " * (n - 1) + "x")


def test_simultaneous_merges_alone_would_be_wrong_on_blanks(monkeypatch):
    monkeypatch.setattr(P, "one_at_a_time", lambda model, word: [model.size - 1])
    assert encoded([" " * 9 + "x"]) != [LIBRARY.encode(" " * 9 + "x", add_eos=True)]


def test_other_models_are_refused(tmp_path):
    raw = open(P.model_file(), "rb").read()
    bad = tmp_path / "no_fallback.model"
    bad.write_bytes(raw + bytes([0x12, 3, 0x98, 2, 0]))  # a second trainer part: byte_fallback off
    with pytest.raises(ValueError, match="byte fallback"):
        P.PieceModel(str(bad))


def test_documents(spark):
    got = P.encode_documents(C.table(spark)).collect()
    want = [(r[0], LIBRARY.encode(r[1] or "", add_eos=True)) for r in C.rows()]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["decoded"] == LIBRARY.decode(list(r["ids"])) for r in got)
    assert P.encode_documents(C.empty(spark)).count() == 0


def test_query_digests(spark):
    from conftest import SF_SMALL
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    out = queries()["op12_piece_codec"](spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
