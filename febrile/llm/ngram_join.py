"""N-gram Jaccard join by MinHash banding.

Similarity is the Jaccard measure of the sets of five-word shingles (ASCII lower
case, split at white space; a text of fewer words is one shingle).  Documents with
the same set form a class and go on as one.  The bands and rows of the MinHash
are chosen from the wanted recall at the threshold.  Rows of (band, hash) are
shuffled; a bucket links its classes to its smallest one, and the connected
parts of that candidate graph are verified on full shingle sets:

* a part is cut into blocks of bounded size by hash, and each pair of blocks is
  one group, so a part of any size is spread over many tasks;
* a group compares its sets by a matrix product over the shingles that at least
  two of them share, and gives one row per class: its number of links, and the
  smallest class it is linked with inside the group.  Pairs are never rows.

All pairs within a part are compared, so only a pair whose ends lie in different
parts can be missed; the bands bound that chance.

Defined results: a null or wordless text has no shingle, is similar to nothing
and is a class of its own; equal texts and repeated rows share a class and are
links of each other; rows with a null id take the class of their set if another
row names it, else null; an id that comes with several texts stands in the class of
each, and may so name several classes; an empty table gives an empty table; extra
input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import WordHash, mix64, read_table, text_or_empty, tidy, written
from febrile.llm.components import bucket_components, components
from febrile.llm.hilbert_shards import ranked


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold_pct: int = 80      # Jaccard, in hundredths: compared in whole numbers
    recall: float = 0.9999       # of pairs at the threshold, by the bands alone
    most_hashes: int = 200       # MinHash values of a document, at most
    block_docs: int = 512        # classes of a block
    block_shingles: int = 400_000  # shingles of a block, about
    seed: int = 20


def choose_bands(params: JoinParams) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest false candidates) whose bands fit ``most_hashes``."""
    t = params.threshold_pct / 100
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - params.recall) / math.log(1 - t ** rows)) if t < 1 else 1
        if bands * rows <= params.most_hashes:
            return bands, rows
    return params.most_hashes, 1


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.memory = words, WordHash()
        self.factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.memory.array(words)
        if len(h) < self.words:
            # fewer words than a shingle: one shingle that also tells their number
            return mix64((h * self.factors[:len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        total = np.zeros(len(h) - self.words + 1, np.uint64)
        for k in range(self.words):
            total += h[k:len(h) - self.words + 1 + k] * self.factors[k]
        return np.unique(mix64(total))


D1, D2 = np.uint64(0), np.uint64(0x5DEECE66D)


def _digest(shingles: np.ndarray, salt: np.uint64) -> int | None:
    """Digest of a set: the sum of its mixed hashes."""
    return int(mix64(shingles ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else None


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(best, ((shingles[k:k + 4096, None] ^ b) * a).min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, h (hash of the text), n (shingles), d1 and d2 (digest of the set), bands (hashes) per row of ``docs``."""
    bands, rows = choose_bands(params)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words)
        base = np.arange(bands * rows, dtype=np.uint64) + np.uint64(params.seed << 32)
        a, b = mix64(base) | np.uint64(1), mix64(base + np.uint64(1 << 60))
        weights = mix64(np.arange(rows, dtype=np.uint64) + np.uint64(977)) | np.uint64(1)
        numbers = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(31))
        for batch in batches:
            n, d1, d2, found = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.set_of(text)
                n.append(len(s))
                d1.append(_digest(s, D1))
                d2.append(_digest(s, D2))
                if len(s):
                    sums = (mix64(_signature(s, a, b)).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
                    found.append(mix64(sums + numbers).view(np.int64))
                else:
                    found.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "d1", "d2", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"), F.xxhash64(text_or_empty()).alias("h"))
    return rows_in.mapInArrow(tidy(sign), "doc_id long, h long, n long, d1 long, d2 long, bands array<long>")


def _verify(group: pd.DataFrame, threshold_pct: int, two: bool) -> pd.DataFrame:
    """Links inside one pair of blocks: per class with a link, how many classes and documents, and its smallest.

    ``two``: the pair is of two blocks, of which one may be empty.
    """
    group = group.drop_duplicates("key")  # repeated rows
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes, copies = group["n"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)
    names, block = group["key"].to_numpy(np.int64), group["block"].to_numpy(np.int64)
    count = len(sets)
    owner = np.repeat(np.arange(count), sizes)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((count, count), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = max(256, 4_000_000 // max(count, 1))
    edges = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + width, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        m = np.zeros((count, width), np.float32)
        m[owner[part], code[part] - k * width] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= threshold_pct * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if two:  # pairs inside either block belong to another group
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(1))
    root = np.arange(count)
    for i in some:  # union by smallest name within the group
        for j in np.flatnonzero(linked[i, i + 1:]) + i + 1:
            a, b = i, j
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                if names[a] < names[b]:
                    root[b] = a
                else:
                    root[a] = b
    tops = []
    for i in some:
        while root[i] != i:
            i = root[i]
        tops.append(names[i])
    return pd.DataFrame({"key": names[some], "classes": linked[some].sum(1), "docs": linked[some] @ copies, "top": np.array(tops, np.int64)})


def ngram_groups(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, class_id (smallest id it is connected with), set_id (smallest id with the same shingle set), n_links
    (other rows at or over the threshold) and n_class_links (other sets), one row per row of ``docs`` (doc_id, text).

    Beside them text_hash, and group: a number that the rows of connected documents share and no others (null without a
    word), where class_id alone may name several groups whose smallest id comes with several texts."""
    signed = written(signatures(docs, params), "join-signatures")
    classes = signed.filter("d1 is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.filter("rep is not null"), "join-classes")
    # a class goes by its smallest id; where one id is that of several classes, by its place in the order of (id, digest)
    shared = classes.groupBy("rep").count().filter("count > 1").limit(1).count() > 0
    if shared:
        classes = ranked(classes, ["rep", "d1", "d2"], "join-names").withColumnRenamed("rank", "key").drop("total")
    else:
        classes = classes.withColumn("key", F.col("rep"))

    # candidates: the classes of a bucket are connected
    firsts = signed.select("doc_id", "d1", "d2", "bands").join(
        classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "key"), ["doc_id", "d1", "d2"]).dropDuplicates(["key"])
    rows = written(firsts.select("key", F.explode("bands").alias("bucket")), "join-bands")
    parts = bucket_components(rows.withColumnRenamed("key", "node"), "join-candidates")

    members = parts.select(F.col("node").alias("key"), F.col("root").alias("part")).join(classes, "key")
    sizes = members.groupBy("part").agg(F.greatest(
        F.ceil(F.count("*") / params.block_docs), F.ceil(F.sum("n") / params.block_shingles)).cast("int").alias("blocks"))
    members = members.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("key", F.lit(params.seed)), F.col("blocks")).cast("int"))

    names = ["key", "part", "d1", "n", "copies", "blocks", "block"]

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words)
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch.column(len(names)).to_pylist()]
            own = [_digest(s, D1) == d for s, d in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"]
            ).filter(pa.array(own, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("t"))
    on = ["rep"]
    if shared:  # each class meets its own text only, not all texts of its id
        of_text = signed.groupBy(F.col("doc_id").alias("rep"), "d1", "d2").agg(F.min("h").alias("h"))
        members, texts, on = members.join(of_text, ["rep", "d1", "d2"]), texts.withColumn("h", F.xxhash64("t")), ["rep", "h"]
    held = members.select(*names, *on).join(texts, on).select(*names, "t").mapInArrow(
        tidy(with_sets), "key long, part long, d1 long, n long, copies long, blocks int, block int, shingles binary")
    work = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("key", "part", "n", "copies", "block", "shingles",
                       F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = work.groupBy("part", "i", "j").applyInPandas(
        lambda key, g: _verify(g, params.threshold_pct, key[1] != key[2]), "key long, classes long, docs long, top long")
    links = written(links, "join-links")
    counts = links.groupBy("key").agg(F.sum("classes").alias("classes"), F.sum("docs").alias("docs"))
    tops = components(links.select(F.col("key").alias("a"), F.col("top").alias("b")), "join-tops")
    if shared:  # the smallest key of a group has its smallest id
        tops = tops.join(classes.select(F.col("key").alias("root"), F.col("rep").alias("top")), "root")
    else:
        tops = tops.withColumn("top", F.col("root"))
    of_class = classes.join(counts, "key", "left").join(tops.withColumnRenamed("node", "key"), "key", "left").select(
        "d1", "d2", "rep", F.coalesce("top", "rep").alias("class_id"), F.coalesce("root", "key").alias("group"), F.coalesce("classes", F.lit(0)).alias("classes"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.select("doc_id", "h", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("set_id"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("classes", F.lit(0)).cast("long").alias("n_class_links"), F.col("h").alias("text_hash"), "group")


def ngram_join(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The classes and link counts of ``ngram_groups`` alone."""
    return ngram_groups(docs, params).drop("text_hash", "group")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))
