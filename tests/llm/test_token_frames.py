import io
import os
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import llm_cases as cases
from febrile.llm.token_frames import FRAME_IDS, Encoder, FrameReader, FrameWriter, read_token_files, shared_encoder, token_output, tokenizer_file, write_token_files

REAL = Tokenizer.from_file(tokenizer_file())
ENCODER = Encoder(tokenizer_file())


def encoded(text):
    return REAL.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcABCzé'st.,!*#&12 \n\t\x1c\xa0İΣßﬁ́नि़क़—|<>"), max_size=30), min_size=1, max_size=4))
def test_ids_equal_the_librarys(texts):
    ids, counts = ENCODER.encode(texts)
    want = [encoded(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_ids_of_special_strings_and_whole_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["a<|endoftext|>b <|startoftext|>", "it's we'll 'tis don't.", "x" * 5000, ""]
    ids, counts = Encoder(tokenizer_file()).encode(texts)
    assert ids.tolist() == [i for t in texts for i in encoded(t)] and counts.sum() == len(ids)


def test_other_vocabularies_are_left_to_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    other, real = Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello, World!  two  blanks", "", "it's\n\n", "x" * 300]
    ids, counts = other.encode(texts)
    want = [real.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert not other.by_words and ENCODER.by_words
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(Encoder, "LIMIT", 3_000)
    monkeypatch.setattr(Encoder, "AT_A_TIME", 7)
    own = Encoder(tokenizer_file())
    for k in range(6):
        texts = [" ".join(f"Word{k}x{i % 50}, na{chr(97 + i % 26)}ve." for i in range(200)), "plain words only"]
        ids, counts = own.encode(texts)
        assert ids.tolist() == [i for t in texts for i in encoded(t)] and own.held < 60_000


def test_files_of_failed_attempts_are_removed(spark, scratch):
    import pathlib

    from febrile.llm import token_frames as T
    marker = os.path.join(scratch, "failed-once")
    fast, folder = T.text_slices, os.path.join(scratch, "out")

    def breaks_once(column, chars):
        yield from fast(column, chars)
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise OSError("a lost disk")

    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    T.text_slices = breaks_once
    try:
        # a local master does not try a task again: the caller does
        with pytest.raises(Exception, match="a lost disk"):
            write_token_files(docs, folder, tokenizer_file()).count()
        assert any(p.name.startswith(T.TRIAL) for p in pathlib.Path(folder).iterdir())
        files = write_token_files(docs, folder, tokenizer_file())
    finally:
        T.text_slices = fast
    assert not any(p.name.startswith(T.TRIAL) for p in pathlib.Path(folder).iterdir())
    got = {r["doc_id"]: r["ids_crc32"] for r in read_token_files(files, folder).collect()}
    assert got == {i: zlib.crc32(np.array(encoded(f"text number {i}"), "<u4").tobytes()) for i in range(40)}


def test_round_trip_of_a_file():
    rnd = np.random.default_rng(0)
    docs = [(i if i else None, rnd.integers(0, 49_000, n).astype(np.uint32)) for i, n in enumerate([3, 70_000, 1, 40_000, 40_000, 2_500_000, 5])]
    out = io.BytesIO()
    w = FrameWriter(out)
    for name, ids in docs:
        w.add(name, ids)
    w.close()
    raw = out.getvalue()
    r = FrameReader(io.BytesIO(raw), len(raw))
    assert [d for d, _, _ in r.documents()] == [d for d, _ in docs]
    for k, ((_, start, ids), (_, want)) in enumerate(zip(r.documents(), docs)):
        assert np.array_equal(ids, want) and np.array_equal(r.document(k), want) and start == sum(len(x) for _, x in docs[:k])
    assert len(r.frames_of(5)) == 3 and len(r.frames_of(0)) == 1 and all(r.raw[:-1] <= 4 << 20)
    # an ordinary reader sees the ids and skips the rest
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(x.tobytes() for _, x in docs)


def test_damage_is_noticed():
    out = io.BytesIO()
    w = FrameWriter(out)
    w.add(1, np.arange(FRAME_IDS, dtype=np.uint32))
    w.close()
    raw = bytearray(out.getvalue())
    r = FrameReader(io.BytesIO(bytes(raw)), len(raw))
    r.sums[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        r.frame(0)
    with pytest.raises(ValueError, match="seek table"):
        FrameReader(io.BytesIO(b"x" * 100), 100)


def test_files_of_a_table(spark, scratch):
    folder = scratch + "/ids"
    files = write_token_files(cases.table(spark), folder, tokenizer_file())
    got = [tuple(r) for r in read_token_files(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = sorted(((r[0], r[1]) for r in cases.rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows) and not [f for f in os.listdir(folder) if f.startswith("_")]
    want = sorted((r[0] is not None, r[0] or 0, len(encoded(r[1])), zlib.crc32(np.array(encoded(r[1]), "<u4").tobytes())) for r in rows)
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == want
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in ordered] == [r[0] for r in rows]
    assert [r[1] for r in ordered] == np.concatenate([[0], np.cumsum([r[2] for r in ordered])[:-1]]).tolist()
    # one task again: the same bytes
    before = {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)}
    write_token_files(cases.table(spark), folder, tokenizer_file())
    assert before == {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)}


def test_empty(spark):
    assert token_output(cases.empty(spark)).count() == 0


def test_tasks_of_a_process_share_the_encoder():
    assert shared_encoder(tokenizer_file()) is shared_encoder(tokenizer_file())


def test_lowered_before_as_by_the_vocabulary():
    texts = ["DON'T SHE'S 'RE X\x0bY\x1cZ HELLO!! A.B?", "J\u030c I\u0307 \u212aELVIN \u00c9 E\u0301!", "ABC\x85D\xa0E", "", "\t\r\n"]
    ids, counts = ENCODER.encode(texts)
    want = [[*x.ids, 1] for x in ENCODER.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_are_told_by_their_case():
    texts = ["A<|ENDOFTEXT|>B <|StartOfText|>.", "É <|EndOfText|> Z", "X <|endoftext|> Y", "— <|ENDOFTEXT|>, K"]
    ids, counts = Encoder(tokenizer_file()).encode(texts)
    want = [encoded(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_the_library_is_given_each_plain_word_once():
    class Given:
        def __init__(self, real):
            self.real, self.texts = real, []

        def encode_batch_fast(self, texts, **options):
            self.texts.append(list(texts))
            return self.real.encode_batch_fast(texts, **options)

    own = Encoder(tokenizer_file())
    own.tokenizer = given = Given(own.tokenizer)
    stems = [a + b + c + "é" for a in "abcdefghij" for b in "klmnopqrst" for c in "aeiouvwxyz"] + ["plain"]
    texts = [" ".join(f(s) + sign for s in stems) for f in (str, str.capitalize, str.upper) for sign in ("", ",", ".", '."')]
    for _ in range(2):
        ids, counts = own.encode(texts)
        assert ids.tolist() == [i for t in texts for i in encoded(t)] and len(counts) == len(texts)
    # the words as one text, then the signs
    assert len(given.texts) == 2 and sorted(given.texts[0][0].split()) == sorted(stems) and sorted(given.texts[1]) == sorted([",", ".", '."'])


def test_remembered_words_stay_small():
    # a worker keeps its words beside the heap of its executor, with the other workers
    encoder, most = Encoder(tokenizer_file()), 56 << 20
    texts = [" ".join("".join(chr(97 + (k * 7919 + j) // 26 ** i % 26) for i in range(6)) for j in range(40_000)) for k in range(0, 120_000, 10_000)]
    first = encoder.encode(texts[:1])[0]
    for text in texts[1:]:
        encoder.encode([text])
        assert encoder.held < most
    assert (encoder.encode(texts[:1])[0] == first).all()
