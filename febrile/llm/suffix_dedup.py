"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in
the corpus (smaller document, or the same document further left), overlaps
included, judged on the input.

Inside a task, suffixes are sorted by a mergesort whose comparisons are
logarithmic: prefix polynomial hashes give any substring's hash in one step, and
a binary search over lengths finds the common extension of two suffixes.  Equal
strings end up side by side and are confirmed byte by byte.

Across tasks, only strings that can repeat are compared:

1. Each string of ``length`` bytes is owned by its anchor, the k-gram of smallest
   hash inside it; equal strings have equal anchors at equal places.  An anchor
   owns a run of neighbouring starts (its block, 30 odd on average).
2. Anchors whose k-gram occurs once in the corpus are dropped.
3. Blocks with the same bytes collapse: all but the first occurrence go whole.
4. First occurrences of blocks that share their k-gram with other blocks are cut
   into cells of eight starts at fixed distances from the k-gram, so that equal
   strings lie at the same place of equal cells.  Each task suffix-sorts its
   cells and drops its own repeats; across tasks, equal cells collapse as blocks
   did.  What all strings of a cell have in common is its core; only cells whose
   core occurs in different cells are looked at string by string, which core
   digest and the few bytes around it decide.
5. Blocks that hold their k-gram twice (short periods), and those that share it
   with such a block, are suffix-sorted start by start instead.

All groupings are sums or minima that combine before the shuffle, so a passage
in a third of all documents is no hot spot; the joins back to occurrences are
split by the engine.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes;
null ids come before all others, and rows with the same id are ordered by their
text, exact repeats being one document; an empty table gives an empty table; extra
input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import mix64, read_table, text_or_empty, written
from febrile.llm.hilbert_shards import ranked

LENGTH, KGRAM = 100, 32
#: Starts of a cell.
CELL = 8
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
#: Bytes of text that a task lays end to end, that it searches for anchors at a time (so that the arrays, eight bytes for
#: each, stay in a core's cache), and that it sorts at a time.
CHUNK, SEARCH, SORT_BYTES = 1 << 20, 1 << 16, 1 << 20
#: Powers that are held; longer data makes its own.
POWERS = (1 << 20) + (1 << 14)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    step = base
    while filled < n:
        m = min(filled, n - filled)
        out[filled:filled + m] = out[:m] * step
        filled += m
        step = np.uint64(step * step)
    return out


@cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for data of a usual length, made once a process."""
    return _both_powers(POWERS)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, BASE), _powers(n, np.uint64(pow(int(BASE), -1, 1 << 64)))


class PrefixHash:
    """Polynomial hashes of all prefixes of a byte string; a substring's hash is a difference, shifted."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        with np.errstate(over="ignore"):
            powers, back = _table() if n <= POWERS else _both_powers(n)
            self.back = back[:n]
            self.sums = np.zeros(n, np.uint64)
            terms = data.astype(np.uint64)
            terms += np.uint64(1)
            terms *= powers[:n - 1]
            np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def all(self, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length``, by place."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.back[:len(out)]
        return out


def common_extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length up to ``most`` on which the suffixes at ``a`` and ``b`` agree, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.of(a, mid) == h.of(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, h: PrefixHash, starts: np.ndarray, length: int) -> np.ndarray:
    """``starts`` in the order of their ``length`` bytes, ties by place: bottom-up mergesort, all merges of a level at once.

    The first eight bytes deal the suffixes to groups, and only those of one
    group are merged.  Each level places an element of one half by a binary
    search in the other half; a comparison finds the common extension by a
    binary search over the prefix hashes.
    """
    order = np.sort(starts)
    lead = np.zeros(len(order), np.uint64)
    for k in range(min(8, length)):
        lead = lead << np.uint64(8) | data[order + k]
    dealt = np.argsort(lead, kind="stable")
    order, lead = order[dealt], lead[dealt]
    new = np.concatenate([[True], lead[1:] != lead[:-1]])
    bounds = np.append(np.flatnonzero(new), len(order))
    sizes = np.diff(bounds)
    # the suffixes of groups of several, by group
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    sizes = sizes[sizes > 1]
    if not len(tied):
        return order
    part, n = order[tied], len(tied)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = start + np.repeat(sizes, sizes)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        x, y = part[a], part[b]
        lcp = common_extension(h, x, y, length)
        at = np.minimum(lcp, length - 1)
        return np.where(lcp == length, ties, data[x + at] < data[y + at])

    index, width = np.arange(n), 1
    inside = index - start
    while width < sizes.max():
        left = (inside // width) % 2 == 0
        run = start + inside // (2 * width) * (2 * width)
        # bounds of the other half
        low = np.where(left, np.minimum(run + width, end), run)
        high = np.where(left, np.minimum(run + 2 * width, end), np.minimum(run + width, end))
        base = low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) // 2
            # an element of the left half goes before equals of the right half, and the other way round
            goes_on = before(mid, active, ~left[active])
            low[active] = np.where(goes_on, mid + 1, low[active])
            high[active] = np.where(goes_on, high[active], mid)
            active = active[low[active] < high[active]]
        part = _placed(part, np.where(left, index, index - width) + (low - base))
        width *= 2
    order[tied] = part
    return order


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[place] = values
    return out


def equal_runs(data: np.ndarray, h: PrefixHash, order: np.ndarray, length: int) -> np.ndarray:
    """Number of the run of equal strings that each suffix of ``order`` lies in, confirmed byte by byte."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        found = np.flatnonzero(h.of(a, length) == h.of(b, length))
        steps = np.arange(length)
        for k in range(0, len(found), 1 << 16):
            f = found[k:k + (1 << 16)]
            same[f + 1] = (data[a[f][:, None] + steps] == data[b[f][:, None] + steps]).all(1)
    return np.cumsum(~same) - 1


def _sliding_min(x: np.ndarray, w: int, best: np.ufunc = np.minimum) -> np.ndarray:
    """Minimum (or, by ``best``, maximum) of each window of ``w`` neighbours, from those of windows that double."""
    have = 1
    while 2 * have <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[:-(w - have)], x[w - have:]) if have < w else x


def blocks_of(data: np.ndarray, length: int = LENGTH, k: int = KGRAM,
              ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hash, first start and number of starts of each anchor's block, where in the block the k-gram stands,
    and whether it does so twice, so that starts of one block may repeat each other (short periods).

    ``data`` may hold several texts laid end to end, ``ends`` their ends: no string crosses one.
    """
    none = np.zeros(0, np.int64)
    out = [(none.view(np.uint64), none, none, none, none.astype(bool))]
    total = max(0, len(data) - length + 1)
    crossing = np.zeros(len(data) + 1, np.int32)
    if ends is not None:
        np.add.at(crossing, np.maximum(ends - length + 1, 0), 1)
        np.add.at(crossing, ends, -1)
    inside = np.cumsum(crossing[:total]) == 0
    reach, most = length - k, length - k + 1
    for at in range(0, total, SEARCH):  # long data in pieces that share length-1 bytes
        part = data[at:min(len(data), at + SEARCH + length - 1)]
        h = PrefixHash(part)
        grams = mix64(h.all(k))
        least = _sliding_min(grams, most)
        ok = inside[at:at + len(least)]
        # neighbouring starts with one smallest k-gram; its leftmost place may move on within a run of equal k-grams
        turn = ok & np.concatenate([[True], (least[1:] != least[:-1]) | ~ok[:-1]])
        stop = np.append(np.flatnonzero(turn | ~ok), len(least))
        first = np.flatnonzero(turn)
        if not len(first):
            continue
        count = stop[np.searchsorted(stop, first, "right")] - first
        # runs are cut so that a block never spans more than one string's worth of starts
        pieces = -(-count // most)
        step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
        first, count = np.repeat(first, pieces) + step, np.minimum(most, np.repeat(count, pieces) - step)
        # places of the smallest k-grams: those that are the minimum of some string around them
        edge = np.zeros(reach, np.uint64)
        anchors = np.flatnonzero(grams == _sliding_min(np.concatenate([edge, np.where(ok, least, np.uint64(0)), edge]), reach + 1, np.maximum))
        near = (grams[anchors[1:]] == grams[anchors[:-1]]) & (np.diff(anchors) <= reach)
        pairs = np.concatenate([[0], np.cumsum(near)])
        low, high = np.searchsorted(anchors[:-1], first), np.searchsorted(anchors[:-1], first + count + reach)
        # every start's string covers the k-gram, so it stands at or after the last start
        spot = np.searchsorted(anchors, first + count - 1)
        while (other := grams[anchors[spot]] != least[first]).any():
            spot[other] += 1
        out.append((least[first], first + at, count, anchors[spot] - first, pairs[high] > pairs[low]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _occurrences(docs: DataFrame, length: int, k: int, full: bool) -> DataFrame:
    """One row per anchor: gram, and with ``full`` also digest, doc, start and shape (starts, place of the k-gram,
    whether it stands there twice, a byte each)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // CHUNK
            for at, end in zip(*(np.searchsorted(group, np.unique(group), side) for side in ("left", "right")), strict=True):
                raw = b"".join(batch.column(1).slice(at, end - at).to_pylist())
                ends = np.cumsum(sizes[at:end])
                gram, start, n, spot, twice = blocks_of(np.frombuffer(raw, np.uint8), length, k, ends)
                if not full:
                    # a task's own repeats are counted here
                    gram, often = np.unique(np.concatenate([gram, gram[twice]]), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "c": pa.array(np.minimum(often, 2).astype(np.int8))})
                    continue
                # a second, unrelated hash of the block's bytes confirms what the k-gram hash suggests
                stops = start + n + length - 1
                digest = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), stops.tolist(), strict=True)]
                owner = np.searchsorted(ends, start, "right")
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array(gram.view(np.int64)), "digest": pa.array(np.array(digest, np.uint64).view(np.int64)),
                    "doc": batch.column(0).take(pa.array(owner + at)), "start": pa.array(start - (ends - sizes[at:end])[owner]),
                    "shape": pa.array((n | spot << 8 | twice.astype(np.int64) << 16).astype(np.int32))})

    fields = "gram long, digest long, doc long, start long, shape int" if full else "gram long, c byte"
    return docs.select("doc", "bytes").mapInArrow(find, fields)


#: Columns of a cell (or, with no core, of a single string): digest, bytes beside the core, place, starts.
CELL_FIELDS = "k1 long, k2 long, left long, right long, doc long, start long, low int, n int, kind int"
WHOLE, STRING, REPEAT = 0, 1, 2  # kinds: a cell, a single string, a run of repeats found inside the task


def _cells(rows: DataFrame, length: int) -> DataFrame:
    """Cells and strings of the blocks of each document (doc, blocks, z), repeats inside a task already told."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, strings = _Sorter(length + CELL - 1, length), _Sorter(length, length)
        for batch in batches:
            blocks, offsets = batch.column(1).values, batch.column(1).offsets.to_pylist()
            begins, shapes, alone = (blocks.field(f).to_numpy(zero_copy_only=False).tolist() for f in range(3))
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw, own = zstandard.ZstdDecompressor().decompress(text), set()
                for b in range(offsets[row], offsets[row + 1]):
                    begin, last = begins[b], begins[b] + (shapes[b] & 255) - 1
                    if alone[b]:
                        for s in range(begin, last + 1):
                            string = raw[s:s + length]
                            if string in own:  # blocks come in order, so the one met before starts earlier
                                strings.repeat(doc, s, 1)
                            else:
                                own.add(string)
                                strings.add(doc, s, 0, 1, string)
                        continue
                    gram = begin + (shapes[b] >> 8 & 255)
                    for cell in range((gram - last) // CELL, (gram - begin) // CELL + 1):
                        core = gram - cell * CELL           # the last start of the cell, and the core's first byte
                        first = max(begin, core - CELL + 1)
                        n = min(last, core) - first + 1
                        if n == CELL:
                            cells.add(doc, first, 0, n, raw[first:first + length + CELL - 1])
                        else:
                            cells.lone(doc, first, core - first - n + 1, n, _padded(raw, core - CELL + 1, length + CELL - 1))
                yield from cells.flush(WHOLE, SORT_BYTES)
                yield from strings.flush(STRING, SORT_BYTES)
        yield from cells.flush(WHOLE, 0)
        yield from strings.flush(STRING, 0)

    return rows.mapInArrow(cut, CELL_FIELDS)


def _padded(raw: bytes, start: int, length: int) -> bytes:
    """``length`` bytes from ``start``; places outside the text are zero (no string that counts covers them)."""
    part = raw[max(start, 0):max(start + length, 0)]
    return b"\0" * (min(start + length, 0) - start if start < 0 and start + length < 0 else max(-start, 0)) + part + b"\0" * max(
        0, start + length - max(len(raw), start, 0))


class _Sorter:
    """Collects equal-length pieces, suffix-sorts them, and gives the first of each distinct one and the repeats."""

    def __init__(self, size: int, length: int):
        self.size, self.length = size, length
        self._empty()

    def _empty(self) -> None:
        self.pieces, self.rows, self.alone, self.places, self.repeats = [], [], [], [], []

    def repeat(self, doc: int, start: int, n: int) -> None:
        """Told in ascending order within a document: neighbours become one run."""
        if self.repeats and self.repeats[-1][0] == doc and self.repeats[-1][1] + self.repeats[-1][3] == start:
            n += self.repeats[-1][3]
            start = self.repeats.pop()[1]
        self.repeats.append((doc, start, 0, n))

    def add(self, doc: int, start: int, low: int, n: int, piece: bytes) -> None:
        self.pieces.append(piece)
        self.rows.append((doc, start, low, n))

    def lone(self, doc: int, start: int, low: int, n: int, piece: bytes) -> None:
        self.alone.append(piece)
        self.places.append((doc, start, low, n))

    def flush(self, kind: int, most: int) -> Iterator[pa.RecordBatch]:
        held = (len(self.pieces) + len(self.alone) + len(self.repeats)) * self.size
        if not held or held <= most:
            return
        repeats = np.array(self.repeats, np.int64).reshape(-1, 4)
        if self.pieces:
            data = np.frombuffer(b"".join(self.pieces), np.uint8)
            h = PrefixHash(data)
            order = suffix_order(data, h, np.arange(len(self.pieces)) * self.size, self.size)
            run = equal_runs(data, h, order, self.size)
            row, rows = order // self.size, np.array(self.rows, np.int64)
            row = row[np.lexsort((rows[row, 1], rows[row, 0], run))]
            lead = np.concatenate([[True], run[1:] != run[:-1]])
            first = row[lead]
            yield from self._told(data.reshape(-1, self.size)[first], rows[first], kind)
            # a repeated row brings its document's pieces again: the first piece of a run is no repeat of itself
            later = (rows[row, :2] != rows[first[run], :2]).any(1)
            repeats = np.concatenate([repeats, rows[row[later]]])
        if self.alone:
            yield from self._told(np.frombuffer(b"".join(self.alone), np.uint8).reshape(-1, self.size), np.array(self.places, np.int64), kind)
        self._empty()
        if len(repeats):  # neighbours become one run
            doc, start, _, n = repeats[np.lexsort((repeats[:, 1], repeats[:, 0]))].T
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
            none = pa.nulls(len(new), pa.int64())
            yield from _cell_rows([none, none, none, none, doc[new], start[new], np.zeros(len(new)), np.add.reduceat(n, new)], REPEAT)

    def _told(self, pieces: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        side = self.size - self.length  # bytes beside the core, left and right
        core, step = pieces[:, side:self.size - side].tobytes(), self.size - 2 * side
        keys = b"".join([xxhash.xxh3_128_digest(core[k:k + step]) for k in range(0, len(core), step)])
        left, right = np.zeros((2, len(pieces)), np.int64)
        for k in range(side):
            left, right = left << 8 | pieces[:, k], right << 8 | pieces[:, self.size - side + k]
        yield from _cell_rows([*np.frombuffer(keys, "<i8").reshape(-1, 2).T, left, right, *rows.T], kind)


def _cell_rows(columns: list, kind: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 6 + [pa.int32()] * 3
    columns = [c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)]
    columns.append(pa.array(np.full(len(columns[0]), kind, np.int32)))
    batch = pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CELL_FIELDS.split(", ")])
    for at in range(0, len(batch), 50_000):
        yield batch.slice(at, 50_000)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the order of documents), doc_id and bytes of every row.

    Where ids repeat or are null, the order of (id, text digest) takes the id's place.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("bytes"))
    if not d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        return d.withColumn("doc", F.col("doc_id"))
    d = d.withColumn("__t", F.sha2("bytes", 256))
    names = d.select("doc_id", "__t").distinct().withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    names = ranked(names, ["__id", "__t"], "suffix-names").select("__id", "__t", F.col("rank").alias("doc"))
    d = d.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    return written(d.join(names, ["__id", "__t"]).select("doc", "doc_id", "bytes"), "suffix-docs")


def _packed(d: DataFrame) -> DataFrame:
    """doc, doc_id and zstandard text: what crosses the shuffle."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [packer.compress(b) for b in batch.column(2).to_pylist()], pa.binary())], names=["doc", "doc_id", "z"])

    return d.select("doc", "doc_id", "bytes").mapInArrow(pack, "doc long, doc_id long, z binary")


def repeated_starts(d: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """doc, start, n: runs of starts whose ``length`` bytes also start earlier, for keyed documents (doc, doc_id, bytes)."""
    grams = _occurrences(d, length, k, False).groupBy("gram").agg(F.sum("c").alias("c")).filter("c > 1").select("gram")
    seen = written(_occurrences(d, length, k, True).join(grams, "gram", "left_semi"), "suffix-blocks")
    firsts = written(seen.groupBy("gram", "digest").agg(F.min(F.struct("doc", "start", "shape")).alias("f"), F.count("*").alias("c")), "suffix-firsts")
    again = firsts.filter("c > 1").select("gram", "digest", F.col("f.doc").alias("fd"), F.col("f.start").alias("fs"))
    whole = seen.join(again, ["gram", "digest"]).filter("doc <> fd or start <> fs").select("doc", "start", F.expr("shape & 255").alias("n"))

    several = firsts.groupBy("gram").agg(F.count("*").alias("m"), F.max(F.col("f.shape") >= 1 << 16).alias("alone")).filter("m > 1 or alone")
    partly = firsts.join(several, "gram").select("f.doc", F.struct("f.start", "f.shape", "alone").alias("b"))
    # a document's own blocks: bounded by its length
    partly = partly.groupBy("doc").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    cells = written(_cells(partly.join(_packed(d), "doc").select("doc", "blocks", "z"), length), "suffix-cells")
    found = cells.filter(F.col("kind") == REPEAT).select("doc", "start", "n")

    # equal cells (and equal single strings): all but the first go whole
    same = ["k1", "k2", "left", "right", "low", "n", "kind"]
    held = cells.filter(F.col("kind") != REPEAT)
    common = held.groupBy("k1").agg(F.count("*").alias("c")).filter("c > 1").select("k1")
    held = written(held.join(common, "k1", "left_semi"), "suffix-shared-cells")
    firsts = written(held.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("c")), "suffix-cell-firsts")
    again = firsts.filter("c > 1").select(*same, F.col("f.doc").alias("fd"), F.col("f.start").alias("fs"))
    cell_runs = held.join(again, same).filter("doc <> fd or start <> fs").select("doc", "start", "n")

    # different cells of one core: string by string; start i of a cell takes its last bytes on the left, its first on the right
    side = CELL - 1
    rest = firsts.filter(F.col("kind") == WHOLE)
    shared = rest.groupBy("k1", "k2").agg(F.count("*").alias("m")).filter("m > 1").select("k1", "k2")
    one = rest.join(shared, ["k1", "k2"], "left_semi").select(
        "k1", "k2", "left", "right", F.col("f.doc").alias("doc"), (F.col("f.start") + F.col("n") - 1).alias("last"), "low",
        F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("i"))
    keep_left = F.col("left").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 8 * F.col("i")) - 1)
    keep_right = F.call_function("shiftright", F.col("right"), 8 * F.col("i"))
    one = one.select("doc", (F.col("last") - F.col("i") + F.col("low")).alias("start"),
                     F.xxhash64("k1", "k2", "i", keep_left, keep_right).alias("s1"),
                     F.xxhash64(F.lit(side), keep_right, keep_left, "i", "k2", "k1").alias("s2"))
    one = written(one, "suffix-strings")
    first = one.groupBy("s1", "s2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = first.select("s1", "s2", F.col("f.doc").alias("fd"), F.col("f.start").alias("fs"))
    single = one.join(first, ["s1", "s2"]).filter("doc <> fd or start <> fs").select("doc", "start", F.lit(1).alias("n"))
    return whole.union(found).union(cell_runs).union(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes and spans (removed runs: start, end) of every row of ``docs``."""
    d = _keyed(docs)
    runs = repeated_starts(d, length).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept, sizes, spans = batch.column(0), [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(text)
                sizes.append(len(raw))
                if not found.is_valid:
                    kept.append(raw)
                    spans.append([])
                    continue
                start, n = (found.values.field(f).to_numpy() for f in ("start", "n"))
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "kept", "n_bytes", "spans"])

    return _packed(d).join(runs, "doc", "left").select("doc_id", "z", "runs").mapInArrow(
        cut, "doc_id long, kept binary, n_bytes long, spans array<struct<start:long,end:long>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
