"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (blanks become U+2581, one is set before
the text) and cut where no merge can cross: before a U+2581 behind another
character, around characters that occur in no longer piece, and before
signs that no piece holds behind a letter.  The new words
of a slice are encoded together: one flat numpy array of symbols, and in each
round

* the rank of every neighbouring pair inside a word (the order of the scores),
* the smallest rank of each word, as a segmented minimum,
* the merge of that pair wherever it stands in the word, leftmost first and
  without overlap, all words at the same time,
* compaction; words without a pair are done and leave the array.

The library merges one pair at a time, best score first, leftmost among equals.
Both orders agree unless a merge makes a pair that ranks as high as the one just
merged (runs of blanks, whose pieces share one score).  Each round looks for such
pairs; the words where one shows up are encoded again, one merge at a time from a
heap.  Characters without a piece become their UTF-8 bytes.

Words are remembered up to a bound in bytes.  Rows are independent: no shuffle.

Defined results: a null or empty text is the end id alone and decodes to the empty
text; repeated rows and ties in anything but scores do not matter; a very long text
is encoded whole, in memory of its own size; an empty table gives an empty table;
extra input columns are ignored.  Only BPE models with byte fallback, identity
normalisation and ordinary pieces are taken; others raise an error.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import read_table, text_or_empty, text_slices

BLANK = "▁"
#: Piece types and the model type of the public file format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Texts are taken from a batch until they hold this many characters; output rows are given at that pace.
SLICE_CHARS = 500_000


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at:at + size]
        at += size


class PieceModel:
    """Pieces, ranks and merges of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.texts, scores, self.types = [], [], []
        trainer, normalizer = {3: 1}, {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer |= dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        blanks_as_they_are = normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        if trainer[3] != BPE or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or not blanks_as_they_are:
            raise ValueError(f"{path}: not a BPE model with byte fallback, identity normalisation and a blank before the text")
        if set(self.types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: the model has unused or user-defined pieces")
        self.size = len(self.texts)
        self.end_id = next(i for i, t in enumerate(self.texts) if t == (trainer[47].decode() if 47 in trainer else "</s>"))
        self.bytes = np.zeros(256, np.int64)
        for i, (text, kind) in enumerate(zip(self.texts, self.types, strict=True)):
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
        self.ids = {t: i for i, t in enumerate(self.texts) if self.types[i] == NORMAL}
        # equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank_of = np.full(self.size, np.iinfo(np.int64).max)
        pairs: dict[int, int] = {}
        longer: set[str] = set()
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size   # a character without a piece stands for itself
        for text, i in self.ids.items():
            self.rank_of[i] = order[scores[i]]
            if len(text) == 1:
                self.symbol[ord(text)] = i
                continue
            longer.update(text)
            if any(c not in self.ids for c in text):
                raise ValueError(f"{path}: a character of piece {i} is no piece")
            if BLANK in text.lstrip(BLANK):
                raise ValueError(f"{path}: piece {i} reaches over a word's end")
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.merges = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # characters that belong to no longer piece stand alone, and signs that no piece has behind a letter open a
        # word; only ASCII ones are worth a cut
        alone = {chr(c) for c in range(128)} - longer
        signs = {chr(c) for c in range(128) if not chr(c).isalnum()} - alone
        while True:
            late = {b for t in self.ids for a, b in zip(t, t[1:], strict=False) if b in signs and a != BLANK and a not in signs}
            if not late:
                break
            signs -= late
        a, p = (re.escape("".join(sorted(x))) for x in (alone, signs))
        opening = f"[{p}]*" if p else ""
        self.cut = re.compile(f"{BLANK}+{opening}[^{BLANK}{a}{p}]*|[^{BLANK}{a}{p}]+|[{a}]+" + (f"|[{p}]+[^{BLANK}{a}{p}]*" if p else ""))

    def pieces_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, -1 for none."""
        if not len(self.pair_keys):
            return np.full(len(left), -1)
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)


NONE = np.iinfo(np.int64).max


def merge_rounds(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words end to end after the last merge, and their number in each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = model.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    word = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ties = np.zeros(len(words), bool)

    def ranks(made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, model.rank_of[made], NONE)

    while len(symbols):
        last = np.append(word[1:] != word[:-1], True)
        made = np.full(len(symbols), -1)
        inside = np.flatnonzero(~last)
        made[inside] = model.pieces_of_pairs(symbols[inside], symbols[inside + 1])
        rank = ranks(made)
        starts = np.flatnonzero(np.append(True, last[:-1]))
        sizes = np.diff(np.append(starts, len(symbols)))
        least = np.minimum.reduceat(rank, starts)
        finished = np.repeat(least == NONE, sizes)
        if finished.any():
            done.append((symbols[finished], word[finished]))
            keep = ~finished
            symbols, word, made, rank = symbols[keep], word[keep], made[keep], rank[keep]
            sizes, least = sizes[least != NONE], least[least != NONE]
            if not len(symbols):
                break
        # leftmost occurrences without overlap: every other one of a run
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        begins = np.append(True, at[1:] != at[:-1] + 1)
        nth = np.arange(len(at))
        at = at[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0]
        merged, best, owner = made[at], rank[at], word[at]
        before = symbols.copy()
        symbols[at] = merged
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # a new pair may rank no higher than those merged beside it; else the order of merges matters
        several = np.append(owner[1:] == owner[:-1], False) | np.append(False, owner[1:] == owner[:-1])
        if several.any():
            p, piece, r, w = at[several], merged[several], best[several], owner[several]
            behind, ahead = np.minimum(p + 2, len(symbols) - 1), np.maximum(p - 1, 0)
            ahead = np.where(keep[ahead], ahead, np.maximum(p - 2, 0))
            for new, beside in ((model.pieces_of_pairs(piece, before[behind]), behind),
                                (model.pieces_of_pairs(piece, symbols[behind]), behind),
                                (model.pieces_of_pairs(symbols[ahead], piece), ahead)):
                ties[w[(word[beside] == w) & (beside != p) & (ranks(new) <= r)]] = True
        symbols, word = symbols[keep], word[keep]
    if done:
        symbols, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
    counts = np.bincount(word, minlength=len(words)).astype(np.int64)
    if ties.any():
        parts = np.split(symbols, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(ties):
            parts[k] = np.array(one_at_a_time(model, words[k]), np.int64)
        symbols, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return symbols, counts


def one_at_a_time(model: PieceModel, word: str) -> list[int]:
    """Symbols of one word: best pair first, leftmost among equals."""
    symbols = model.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
    ahead, behind = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(symbols) and max(symbols[i], symbols[j]) < model.size:
            piece = model.merges.get(symbols[i] * model.size + symbols[j])
            if piece is not None:
                heapq.heappush(heap, (int(model.rank_of[piece]), i, symbols[i], symbols[j]))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = behind[i] if symbols[i] == left else len(symbols)
        if j >= len(symbols) or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = model.merges[left * model.size + right], -1
        behind[i] = behind[j]
        if behind[i] < len(symbols):
            ahead[behind[i]] = i
        offer(ahead[i], i)
        offer(i, behind[i])
    return [s for s in symbols if s >= 0]


class Encoder:
    """Token ids of texts; the ids of words met before are remembered up to ``limit`` bytes, about."""

    #: Bytes that a remembered word takes beside its characters and ids.
    PER_WORD = 160

    def __init__(self, model: PieceModel, limit: int = 48 << 20):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.at, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        symbols, counts = merge_rounds(self.model, words)
        odd = np.flatnonzero(symbols >= self.model.size)
        if len(odd):  # characters without a piece
            spelled = [self.model.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (symbols[odd] - self.model.size).tolist()]
            wide = np.fromiter(map(len, spelled), np.int64, len(spelled))
            owner = np.repeat(np.arange(len(counts)), counts)
            np.add.at(counts, owner[odd], wide - 1)
            repeats = np.ones(len(symbols), np.int64)
            repeats[odd] = wide
            first = np.cumsum(repeats) - repeats
            symbols = np.repeat(symbols, repeats)
            symbols[np.repeat(first[odd] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())] = np.concatenate(spelled)
        self.rows.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, symbols.astype(np.int32)])
        self.held += sum(map(len, words)) * 2 + 4 * len(symbols) + self.PER_WORD * len(words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and their numbers."""
        if self.held > self.limit:
            self._forget()
        find = self.model.cut.findall
        split = [find(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        words = [w for s in split for w in s]
        new = set(words) - self.rows.keys()
        if new:
            self._learn(list(new))
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        at, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.cumsum([len(s) for s in split], dtype=np.int64)]
        ids = self.ids[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        return np.insert(ids, bounds, self.model.end_id), np.diff(bounds, prepend=0) + 1


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id) and decoded (the library's ``decode`` of the ids) of every row of ``docs`` (doc_id, text)."""
    path = model or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        encoder = decoder = None
        for batch in batches:
            if encoder is None:
                encoder, decoder = Encoder(PieceModel(path)), sentencepiece.SentencePieceProcessor(model_file=path)
            for first, texts in text_slices(batch.column(1), SLICE_CHARS):
                ids, counts = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                text = [decoder.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists, pa.array(text, pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(read_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
