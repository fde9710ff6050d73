"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.session import scratch_path

#: Columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs no recomputation of what came before.
    """
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark removes them once the driver's garbage collector has found them
    unused, which by itself may take half an hour; a job of many steps would
    fill the executors' disks until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_memory() -> None:
    """Give the memory that this process holds unused back to the machine.

    A worker outlives its tasks and serves the steps that follow; what its
    allocators hold back stands beside the executor's heap until it ends.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` over a task's batches, after which the worker gives back what it no longer uses."""
    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        free_memory()

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column of texts, about ``chars`` bytes at a time, so that a batch is never held twice."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    first = 0
    while first < len(texts):
        held = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, held + chars, "right")))
        yield first, texts.slice(first, end - first).to_pylist()
        first = end


class WordHash(dict):
    """Word -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
