"""Token-ID files of independent zstandard frames with a trailing seek table.

Layout of a file (all numbers little-endian):

* data frames: each an ordinary zstandard frame of token ids (unsigned 32-bit);
  a frame holds whole documents, or a part of one long document;
* one skippable frame (magic 0x184D2A50): the document index, compressed: number
  of documents, their ids, null marks and token counts;
* the seek table, a skippable frame (magic 0x184D2A5E) in the public seekable
  layout: for every frame its compressed size, its size and the low 32 bits of
  the xxh64 of its content, then the number of frames, a descriptor byte and the
  closing magic 0x8F92EAB1.

Any zstandard tool reads such a file whole; a reader that wants one document
takes the footer, the index and that document's frames only.

Documents are dealt to files by id ranges and written in ascending order, each
file by one task under a name of the attempt, then moved into place; a task that
runs again after a lost executor writes the same bytes.

Defined results: a null or empty text is its end id alone; null ids come first
and stay null; repeated ids are ordered by text; an empty table writes no file and
gives an empty table; extra input columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from febrile.llm.common import read_table, shuffle_width, text_or_empty, text_slices, tidy, written
from febrile.session import scratch_path

END_ID = 1
#: Magic numbers of the frames.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Token ids after which a frame closes, and the most that one frame holds.
FRAME_IDS, LONGEST_FRAME_IDS = 1 << 16, 1 << 20


#: How the names of unfinished files begin.
TRIAL = "_trial-"
#: Characters that are encoded at a time, about.
ENCODE_CHARS = 500_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts by their words between blanks, remembering the ids of words met before.

    No token of this vocabulary spans white space, and letters never share a
    piece with the signs behind them, so a text's ids are those of its words and
    of the signs at their ends, one after the other.  Arrow splits the texts and
    finds the distinct words, so that only those are looked up.  New plain words are
    encoded many at a time as one text: each is one piece, whose last id carries
    the vocabulary's word end; should the ends not add up, they are encoded one
    by one.  Vocabularies whose settings differ are left to the library, text by text.
    """

    #: Bytes of remembered words and ids, about, and what one word takes beside its characters.
    LIMIT, PER_WORD = 48 << 20, 150
    #: Texts that the library is given at a time; it answers with an object of about a kilobyte for each.
    AT_A_TIME = 2_000
    #: Plain words that the library is given as one text.
    TOGETHER = 10_000
    #: The settings under which words can be encoded apart (see the vocabulary's file).
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Signs that may end a word; an apostrophe may not, because it can open a piece of its own.
    SIGNS = ".,;:!?*#$%&|)]}\""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        split = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_words = (settings["model"].get("end_of_word_suffix") == "</w>" and split.get("pattern") == {"Regex": self.SPLIT}
                         and (settings["normalizer"] or {}).get("normalizers") == self.NORMALIZERS)
        self.added = [t["content"] for t in settings["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # plain words, and whatever else was encoded by itself; all ids end to end
        self.plain: dict[str, int] = {}
        self.other: dict[str, int] = {"": 0}
        self.ids, self.at, self.len = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def _keep(self, to: dict[str, int], parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.at)
        to.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.len = np.concatenate([self.len, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.held += sum(map(len, parts)) + self.PER_WORD * len(parts) + 4 * len(ids)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each text, and their numbers."""
        ids, sizes = [], []
        for k in range(0, len(texts), self.AT_A_TIME):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k:k + self.AT_A_TIME], add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _one_by_one(self, to: dict[str, int], parts: list[str]) -> None:
        if parts:
            self._keep(to, parts, *self._each(parts))

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), self.TOGETHER):
            some = words[k:k + self.TOGETHER]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) == len(some) and ends[-1] == len(got):
                self._keep(self.plain, some, got, np.diff(ends, prepend=0))
            else:
                self._one_by_one(self.plain, some)

    def _parts(self, words: pa.Array) -> np.ndarray:
        """Numbers of what each word is made of: a plain word and the signs behind it, or the word as it is and nothing."""
        cut = pc.ascii_lower(pc.utf8_rtrim(words, characters=self.SIGNS))
        stems = _strings(cut)
        stem = _looked_up(self.plain, stems)
        if len(new := np.flatnonzero(stem < 0)):
            some = [stems[i] for i in new.tolist()]
            # a letter that the vocabulary's normaliser takes apart could join the signs behind it
            self._learn(list({s for s in some if s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())}))
            stem[new] = _looked_up(self.plain, some)
        odd = np.flatnonzero(stem < 0)
        signed = np.flatnonzero((stem >= 0) & (pc.binary_length(words).to_numpy() > pc.binary_length(cut).to_numpy()))
        whole = _strings(words.take(pa.array(odd)))
        signs = [w[len(stems[i]):] for i, w in zip(signed.tolist(), _strings(words.take(pa.array(signed))), strict=True)]
        self._one_by_one(self.other, list({*whole, *signs} - self.other.keys()))
        stem[odd] = _looked_up(self.other, whole)
        sign = np.zeros(len(stem), np.int64)
        sign[signed] = _looked_up(self.other, signs)
        return np.stack([stem, sign], axis=1)

    def _lowered(self, text: str) -> str:
        """Lowered where no other step of the vocabulary sees the difference: Latin letters that are whole as they are.

        Marks that join a letter may know its lower form alone, and added tokens are told by their case.
        """
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        return text if any(a in low for a in self.added) else low

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and their numbers."""
        if not self.by_words:
            ids, counts = self._each(texts)
            return np.insert(ids, np.cumsum(counts), END_ID).astype("<u4"), counts + 1
        if self.held > self.LIMIT:
            self._forget()
        spaced = [self._lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        parts = self._parts(words.dictionary)
        # the ids of the distinct words, then of all words
        sizes = self.len[parts]
        ids = _slices(self.ids, self.at[parts].ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1)
        at, row = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        length = sizes[row]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        counts = np.diff(ends, prepend=0)
        return np.insert(_slices(ids, at[row], length), ends, END_ID).astype("<u4", copy=False), counts + 1


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _looked_up(table: dict[str, int], keys: list[str]) -> np.ndarray:
    return np.fromiter(map(table.get, keys, repeat(-1)), np.int64, len(keys))


def _slices(values: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``length`` values from each place of ``at``, end to end."""
    before = np.cumsum(length) - length
    return values[np.repeat(at - before, length) + np.arange(length.sum())]


@lru_cache(maxsize=2)
def _encoder(path: str, size: int, changed: int) -> Encoder:
    return Encoder(path)


def shared_encoder(path: str) -> Encoder:
    """The process's encoder of this file: a worker's later tasks find the vocabulary read and the words met before."""
    of = os.stat(path)
    return _encoder(path, of.st_size, of.st_mtime_ns)


class FrameWriter:
    """Writes the layout above to a binary stream."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        if len(ids) >= FRAME_IDS:
            self._flush()
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.pending).astype("<u4")
        self.pending, self.held = [], 0
        for k in range(0, len(ids), LONGEST_FRAME_IDS):
            raw = ids[k:k + LONGEST_FRAME_IDS].tobytes()
            packed = self.packer.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        index = struct.pack("<Q", len(self.doc_ids)) + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        index += np.array([d is None for d in self.doc_ids], "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        index = self.packer.compress(index)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads documents of one file; ``source`` is a random-access binary file of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        self.first_ids = np.concatenate([[0], np.cumsum(self.raw) // 4])
        body = self._at(int(self.starts[n - 1]) + 8, int(self.packed[-1]) - 8)
        index = zstandard.ZstdDecompressor().decompress(body)
        docs = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8)
        self.nulls = np.frombuffer(index, "u1", docs, 8 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> np.ndarray:
        raw = self.unpacker.decompress(self._at(int(self.starts[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, "<u4")

    def frames_of(self, doc: int) -> range:
        """Frames that hold the document at this place in the file."""
        first = int(np.searchsorted(self.first_ids, self.doc_starts[doc], "right")) - 1
        last = int(np.searchsorted(self.first_ids, self.doc_starts[doc + 1], "left"))
        return range(first, last)

    def document(self, doc: int) -> np.ndarray:
        frames = self.frames_of(doc)
        ids = np.concatenate([self.frame(k) for k in frames])
        skip = self.doc_starts[doc] - self.first_ids[frames[0]]
        return ids[skip:skip + self.counts[doc]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order, one frame in memory at a time beside the document's own."""
        have, at, k = np.zeros(0, np.uint32), 0, 0
        for d in range(len(self.counts)):
            need, parts = int(self.counts[d]), []
            while need:
                if at == len(have):
                    have, at, k = self.frame(k), 0, k + 1
                    continue
                part = have[at:at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield (None if self.nulls[d] else int(self.doc_ids[d])), int(self.doc_starts[d]), np.concatenate(parts)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder (local mount, or an object or HDFS store that Arrow knows)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files below ``folder``; one row per file: part, path, n_docs, n_ids, n_bytes."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = open_folder(folder)
        encoder = final = trial = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = shared_encoder(tokenizer)
                final = f"{path}/part-{task.partitionId():06d}.ids.zst"
                trial = f"{path}/{TRIAL}{task.partitionId():06d}-{task.taskAttemptId()}"
                stream = fs.open_output_stream(trial, compression=None)
                writer = FrameWriter(stream)
            names = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1), ENCODE_CHARS):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                for name, s, e in zip(names[first:first + len(texts)], ends - counts, ends, strict=True):
                    writer.add(name, ids[s:e])
        if writer is None:
            return
        writer.close()
        size = stream.tell()
        stream.close()
        fs.move(trial, final)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()), "path": [final],
            "n_docs": pa.array([len(writer.counts)], pa.int64()), "n_ids": pa.array([sum(writer.counts)], pa.int64()),
            "n_bytes": pa.array([size], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    rows = rows.repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("t"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("t"), "t")
    files = written(rows.mapInArrow(tidy(write), "part int, path string, n_docs long, n_ids long, n_bytes long"), "token-files")
    for left in fs.get_file_info(pafs.FileSelector(path)):  # by attempts that failed or lost their executor
        if left.base_name.startswith(TRIAL):
            fs.delete_file(left.path)
    return files


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, path and place of every document, from the files alone."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as source:
                    out: list[tuple] = []
                    for place, (doc, start, ids) in enumerate(FrameReader(source, source.size()).documents()):
                        out.append((doc, row["before"] + start, len(ids), zlib.crc32(ids.tobytes()), row["path"], place))
                        if len(out) == 20_000:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    # one row per file, no more than the session's shuffle width
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    placed = placed.repartition(shuffle_width(files.sparkSession), "part")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, place long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "place"])


def token_output(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and give back what the files hold."""
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, tokenizer or tokenizer_file()), folder)


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "place")
