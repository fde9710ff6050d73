"""Hard-negative mining: exact integer inner products by Strassen's recursion.

Every anchor meets every row.  Anchors and rows are dealt to blocks by a hash of
their id; a cell is one anchor block and one row block, an anchor is copied to
each row block and a row to each anchor block (there are few: an anchor block
holds thousands of vectors).  Cells are groups of bounded size whatever label,
cluster or repeated vector the rows carry.

In a cell the vectors become int64 tiles, padded with zeros to one length.  The
product is Strassen's: seven products of half size and exact integer additions,
down to leaves.  Integers wrap, so any score that fits 64 bits is exact; a leaf
whose sums stay below 2^53 is multiplied in doubles, which are exact there too.

Two rounds of cells.  The first keeps for each anchor a heap of its best rows of
the same label; heaps of cells are merged by anchor.  The second keeps for each
anchor and positive a heap of the best rows of other labels inside the window of
that positive's score, merged in the same way.  Of rows with equal label and
vector only the smallest ids can enter a heap of k, so a tile keeps k + 1 of them.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; vectors of different lengths count as padded with zeros,
an empty one scores 0; the id is a key: repeated rows count once, the anchor is
the smallest (label, vector) of its id, a candidate counts with its best score;
equal scores go by smaller id; very long vectors cost memory in proportion; a
component of 2^53 or more after scaling raises an error; an empty table, or one
without anchors, gives an empty table; extra input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from febrile.llm.common import read_table, written


@dataclass(frozen=True)
class MineParams:
    scale: int = 256            # a component x becomes floor(scale * x)
    positives: int = 5
    negatives: int = 5
    low_pct: int = 80           # a negative scores from this share of the positive's score, in hundredths,
    high_pct: int = 100         # to this one
    anchor_block: int = 4096    # anchors of a cell, about
    row_block: int = 4096       # rows of a cell, about
    leaf: int = 32              # side from which a product is no longer split


EXACT = 1 << 53


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2^64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * k
        if 0 <= most < EXACT:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    m2, k2, n2 = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    out = np.zeros((2 * m2, 2 * n2), np.int64)
    o11, o12, o21, o22 = out[:m2, :n2], out[:m2, n2:], out[m2:, :n2], out[m2:, n2:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    o11 += p
    o22 += p
    p = strassen(a21 + a22, b11, leaf)
    o21 += p
    o22 -= p
    p = strassen(a11, b12 - b22, leaf)
    o12 += p
    o22 += p
    p = strassen(a22, b21 - b11, leaf)
    o11 += p
    o21 += p
    p = strassen(a11 + a12, b22, leaf)
    o11 -= p
    o12 += p
    o22 += strassen(a21 - a11, b11 + b12, leaf)
    o11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def tile(vectors: pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, padded with zeros."""
    flat = vectors.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(flat), np.int64)
    values = np.floor(scale * np.asarray(flat.flatten(), np.float64))
    if len(values) and np.abs(values).max() >= EXACT:
        raise ValueError("a component is too large for exact scores")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values.astype(np.int64)
    return out


def longest(*columns: pa.ChunkedArray) -> int:
    return max((pa.compute.max(pa.compute.list_value_length(c)).as_py() or 0 for c in columns if len(c)), default=0)


def smallest_of_equals(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` smallest ids of each (label, vector), in ascending order of id."""
    mark = rows @ (np.arange(1, rows.shape[1] + 1, dtype=np.int64) * np.int64(0x5851F42D4C957F2D) | np.int64(1))
    order = np.lexsort((ids, labels, mark))
    i, j = order[1:], order[:-1]
    same = (mark[i] == mark[j]) & (labels[i] == labels[j])
    same[same] = (rows[i[same]] == rows[j[same]]).all(axis=1)
    order, same = order[np.append(True, ~(same & (ids[i] == ids[j])))], same  # a repeated row counts once
    i, j = order[1:], order[:-1]
    same = (mark[i] == mark[j]) & (labels[i] == labels[j])
    same[same] = (rows[i[same]] == rows[j[same]]).all(axis=1)
    nth = np.arange(len(order))
    begins = np.maximum.accumulate(np.where(np.append(True, ~same), nth, 0))
    order = order[nth - begins < keep]
    return order[np.argsort(ids[order], kind="stable")]


#: Score of an empty place; it has a negative, unlike the smallest integer.
LOWEST = np.iinfo(np.int64).min + 1


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` heaps: higher score first, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOWEST)
        self.name = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, heap: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(heap):
            return
        touched = np.unique(heap)
        at = np.concatenate([np.repeat(touched, self.k), heap])
        score = np.concatenate([self.score[touched].ravel(), score])
        name = np.concatenate([self.name[touched].ravel(), name])
        order = np.lexsort((-score, name, at))  # one id counts once, with its best score
        again = (at[order][1:] == at[order][:-1]) & (name[order][1:] == name[order][:-1]) & (name[order][1:] != np.iinfo(np.int64).max)
        order = order[np.append(True, ~again)]
        order = order[np.lexsort((name[order], -score[order], at[order]))]
        nth = np.arange(len(order))
        begins = np.maximum.accumulate(np.where(np.append(True, at[order][1:] != at[order][:-1]), nth, 0))
        best = nth - begins < self.k
        order, nth = order[best], (nth - begins)[best]
        self.score[at[order], nth], self.name[at[order], nth] = score[order], name[order]

    def bound(self) -> np.ndarray:
        return self.score[:, -1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heap, place = np.nonzero(self.name != np.iinfo(np.int64).max)
        return heap, self.score[heap, place], self.name[heap, place]


#: Rows of a tile whose scores are held at a time.
STRIP = 1024


def _cell(anchors: pa.Table, rows: pa.Table, p: MineParams):
    """Ids, labels and tile of the anchors, and of the rows that can enter a heap."""
    width = longest(anchors["vec"], rows["vec"])
    a = tile(anchors["vec"], p.scale, width)
    ids, labels = np.asarray(rows["id"], np.int64), np.asarray(rows["label"], np.int64)
    b = tile(rows["vec"], p.scale, width)
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width >= 1 << 56:
        raise ValueError("scores could leave 64 bits")
    keep = smallest_of_equals(ids, labels, b, max(p.positives, p.negatives) + 1)
    return np.asarray(anchors["id"], np.int64), np.asarray(anchors["label"], np.int64), a, ids[keep], labels[keep], b[keep]


def _best_places(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where ``fits``; of a row with very many, those that may be among its ``k`` best."""
    if score.shape[1] > k and np.count_nonzero(fits) > 8 * k * len(score):
        masked = np.where(fits, score, LOWEST)
        fits &= score >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    return np.nonzero(fits)


ENTRY = "anchor_id long, window int, score long, other long"
NO_ENTRY = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("other", pa.int64())])


def _entries(names: np.ndarray, window: np.ndarray, score: np.ndarray, other: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(names), pa.array(window, pa.int32()), pa.array(score), pa.array(other)], schema=NO_ENTRY)


def positive_heaps(anchors: pa.Table, rows: pa.Table, p: MineParams) -> pa.Table:
    """Entries of each anchor's heap of same-label rows in one cell."""
    if not len(anchors) or not len(rows):
        return NO_ENTRY.empty_table()
    names, own, a, ids, labels, b = _cell(anchors, rows, p)
    heaps = Heaps(len(names), p.positives)
    for label in np.intersect1d(own, labels):  # scores of equal labels only
        of, cand = np.flatnonzero(own == label), np.flatnonzero(labels == label)
        for k in range(0, len(cand), STRIP):
            some = cand[k:k + STRIP]
            score = strassen(a[of], b[some].T, p.leaf)
            i, j = _best_places(score, (score >= heaps.bound()[of][:, None]) & (names[of][:, None] != ids[some]), p.positives)
            heaps.offer(of[i], score[i, j], ids[some][j])
    heap, score, other = heaps.entries()
    return _entries(names[heap], np.zeros(len(heap)), score, other)


def negative_heaps(anchors: pa.Table, rows: pa.Table, p: MineParams) -> pa.Table:
    """Entries of each (anchor, positive)'s heap of other-label rows inside its window, in one cell."""
    if not len(anchors) or not len(rows):
        return NO_ENTRY.empty_table()
    names, own, a, ids, labels, b = _cell(anchors, rows, p)
    top = anchors["scores"].combine_chunks()
    count = np.asarray(pa.compute.list_value_length(top), np.int64)
    held = np.arange(p.positives) < count[:, None]
    positive = np.zeros((len(names), p.positives), np.int64)
    positive[held] = np.asarray(top.flatten(), np.int64)
    # low * positive <= 100 * negative <= high * positive, in whole numbers; an empty window lies above itself
    low, high = -(-p.low_pct * positive // 100), p.high_pct * positive // 100
    low, high = np.where(held, low, 1), np.where(held, high, 0)
    windows = [Heaps(len(names), p.negatives) for _ in range(p.positives)]
    for k in range(0, len(ids), STRIP):
        some = slice(k, k + STRIP)
        score = strassen(a, b[some].T, p.leaf)
        differs = own[:, None] != labels[some]
        for w, heaps in enumerate(windows):
            floor = np.maximum(low[:, w], heaps.bound())
            i, j = _best_places(score, (score >= floor[:, None]) & (score <= high[:, w][:, None]) & differs, p.negatives)
            heaps.offer(i, score[i, j], ids[some][j])
    parts = []
    for w, heaps in enumerate(windows):
        heap, score, other = heaps.entries()
        parts.append(_entries(names[heap], np.full(len(heap), w), score, other))
    return pa.concat_tables(parts)


def usable(table: DataFrame, id_col: str, label: Column, vector: str) -> DataFrame:
    """id, label and vec of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vec")).filter("label is not null")


def mine(rows: DataFrame, is_anchor: Column, params: MineParams = MineParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``rows`` has id, label and vec."""
    p = params
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("least")).select("id", "least.*")
    anchors = written(anchors, "mine-anchors")
    n_anchors, n_rows = anchors.count(), rows.count()
    blocks = max(1, -(-n_anchors // p.anchor_block)), max(1, -(-n_rows // p.row_block))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = rows.withColumn("j", place(blocks[1])).withColumn("i", every(blocks[0]))

    def cells(side: DataFrame, work) -> DataFrame:
        side = side.withColumn("i", place(blocks[0])).withColumn("j", every(blocks[1]))
        grouped = side.groupBy("i", "j").cogroup(met.groupBy("i", "j"))
        return grouped.applyInArrow(lambda a, b: work(a, b, p), ENTRY)

    def best(entries: DataFrame, k: int) -> DataFrame:
        """Heaps of the cells merged: the first ``k`` of each (anchor, window), by rank."""
        once = entries.repartition("anchor_id", "window").groupBy("anchor_id", "window", "other").agg(F.max("score").alias("score"))
        order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "other")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    tops = written(best(cells(anchors, positive_heaps), p.positives).drop("window"), "mine-positives")
    of_anchor = tops.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("top"))  # at most k
    scored = anchors.join(of_anchor, anchors["id"] == of_anchor["anchor_id"]).select("id", "label", "vec", F.col("top.score").alias("scores"))
    found = best(cells(scored, negative_heaps), p.negatives)
    positives = tops.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("other").alias("positive_id"),
                            F.col("score").alias("positive_score"))
    return found.join(positives, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0)
