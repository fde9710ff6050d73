"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (all words of a shorter
one).  Its words are ordered by rarity over the whole corpus; because a window
must be contained whole, its prefix is the single rarest word.  Only positions
of prefix words in a document become candidates; the window's offset gives the
one possible start, which must lie inside the document (positional and length
bounds), and the words there are compared one by one.

The benchmark is a stated query set: it is held against all documents in blocks
of bounded size, each broadcast, however large it grows.

Defined results: a null or wordless text has no words and is not contaminated;
an item without words has no window; repeated rows are judged row by row; equal
items all count; an empty table on either side gives no hit; other columns pass
through and an input column with the name of a result column is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import read_table, text_or_empty, tidy, written

WINDOW = 13
#: Bytes of benchmark text that one broadcast block may hold.
BLOCK_BYTES = 16 << 20


def _byte_table() -> bytes:
    """Lower-cases A-Z, keeps digits, a-z and all non-ASCII bytes, blanks the rest."""
    keep = lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if keep(b) else 0x20 for b in range(256))


BYTES = _byte_table()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(BYTES).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of ``vocabulary`` (bounded by a benchmark block), over the whole corpus."""
    spread = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = spread.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(text_or_empty().alias("t")).mapInArrow(tidy(count), "word binary, n long")
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per vocabulary word at most
    return {bytes(r["word"]): r["n"] for r in rows}


def prefix_index(items: list[tuple[str, str | None]], frequency: dict[bytes, int]) -> dict[bytes, list]:
    """Prefix word -> (offset, length, words, item ids) of the windows that it stands for."""
    owners: dict[tuple, set[str]] = {}
    for item, text in items:
        for window in windows_of(words_of(text)):
            owners.setdefault(window, set()).add(item)
    index: dict[bytes, list] = {}
    for window, ids in owners.items():
        rarest = min(window, key=lambda w: (frequency.get(w, 0), w))
        if frequency.get(rarest, 0):  # a word of no document: the window occurs nowhere
            index.setdefault(rarest, []).append((window.index(rarest), len(window), list(window), sorted(ids)))
    return index


def find_windows(words: list[bytes], index: dict[bytes, list]) -> tuple[list[int], set[str]]:
    """Starts and ends of the occurring windows, flat and merged, and the items that own them."""
    runs: list[list[int]] = []
    items: set[str] = set()
    n = len(words)
    for at in [i for i, w in enumerate(words) if w in index]:
        for offset, length, window, ids in index[words[at]]:
            start = at - offset
            if start >= 0 and start + length <= n and words[start:start + length] == window:
                runs.append([start, start + length])
                items.update(ids)
    runs.sort()
    flat: list[int] = []
    for s, e in runs:
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [s, e]
    return flat, items


def searcher(spread):
    """The column function that looks for the windows of one broadcast index."""
    def search(texts: pd.Series) -> pd.DataFrame:
        index, found = spread.value, []
        for text in texts:
            words = words_of(text)
            runs, owners = find_windows(words, index)
            found.append((len(words), runs, sorted(owners)))
        return pd.DataFrame(found, columns=["n", "runs", "items"])

    return F.pandas_udf(search, "n long, runs array<int>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, n_items, item_ids, hit_runs (word starts and ends) and contaminated to ``docs``."""
    added = ["n_words", "n_hit", "n_items", "item_ids", "hit_runs", "contaminated"]
    spark = docs.sparkSession
    out = docs.select(*[c for c in docs.columns if c not in added])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), text_or_empty().alias("t"))
    held = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-2 * held // block_bytes))
    zero = F.array().cast("array<int>")
    out = out.select("*", zero.alias("__runs"), F.array().cast("array<string>").alias("__items"), F.lit(None).cast("long").alias("__n"))
    for k in range(n_blocks):
        block = [(r["id"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)) == k).collect()]
        vocabulary = {w for _, t in block for w in words_of(t)}
        spread = spark.sparkContext.broadcast(prefix_index(block, document_frequencies(docs, vocabulary)))

        out = out.withColumn("__f", searcher(spread)(text_or_empty()))
        out = out.withColumns({"__n": F.col("__f.n"), "__runs": F.concat("__runs", "__f.runs"),
                               "__items": F.concat("__items", "__f.items")}).drop("__f")
        if n_blocks > 1:
            out = written(out, "contamination-block")
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("__runs") - 2, F.lit(2)), lambda i: F.struct(
        F.get("__runs", i).alias("s"), F.get("__runs", i + 1).alias("e"))))
    pairs = F.when(F.size("__runs") > 0, pairs)
    n_hit = F.aggregate(
        pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["end"], r["s"]))).alias("n"),
                              F.greatest(a["end"], r["e"]).alias("end")), lambda a: a["n"])
    out = out.withColumns({"n_words": F.col("__n"), "n_hit": F.coalesce(n_hit, F.lit(0)).cast("long"),
                           "item_ids": F.sort_array(F.array_distinct("__items")), "hit_runs": F.col("__runs")})
    out = out.withColumn("n_items", F.size("item_ids").cast("long"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.drop("__runs", "__items", "__n")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
