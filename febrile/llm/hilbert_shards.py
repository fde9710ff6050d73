"""Sharding along a Hilbert curve (native columns only).

Several metadata dimensions are quantised, rows are sorted by their index on
the curve through that grid, and the sorted rows are cut into runs of equal row
counts (counts at most one apart).  Rows near each other on the curve agree in
most dimensions, so a reader prunes shards on any of them.

Equal texts take the curve index of their first row, so copies stand side by
side and a group is cut only where a run ends inside it.

Defined results: a null text has size 8 and crc 0; null metadata has a cell of
its own; null ids sort first; repeated rows each get a slot; an empty table
gives an empty table; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from febrile.llm.common import read_table, shuffle_width, written

DIMENSIONS, BITS = 3, 5


def curve_tables(n: int = DIMENSIONS) -> tuple[list[int], list[int]]:
    """Per state and cell of a 2^n cube: the cell's place on the curve, and the state inside it.

    A state is the corner where the curve enters the cube (n bits) and the axis
    along which it leaves.  The order inside a cube is the reflected Gray code,
    turned to start at that corner and end along that axis.
    """
    size = 1 << n
    rotl = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (size - 1)
    gray = [w ^ (w >> 1) for w in range(size)]
    place_of = {g: w for w, g in enumerate(gray)}
    ones = lambda x: (x ^ (x + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]
    axis = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(size)]
    place, state = [], []
    for corner in range(size):
        for along in range(n):
            for cell in range(size):
                turned = rotl(cell ^ corner, n - (along + 1) % n)
                w = place_of[turned]
                place.append(w)
                state.append((corner ^ rotl(entry[w], along + 1)) * n + (along + axis[w] + 1) % n)
    return place, state


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a point with ``bits`` bits per dimension."""
    n = len(dims)
    place, state = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for k, d in enumerate(dims):
            bit = F.call_function("shiftright", d, level).bitwiseAND(F.lit(1))
            cell = cell + bit * (1 << k)
        at = acc["state"] * (1 << n) + cell
        return F.struct(F.get(state, at).alias("state"), (acc["index"] * (1 << n) + F.get(place, at)).alias("index"))

    zero = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, step, lambda a: a["index"])


def quantise_label(c: Column, bits: int = BITS) -> Column:
    """A label's cell: equal labels share one, so equality filters prune."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\x00null"))), F.lit(1 << bits)).cast("int")


def quantise_size(c: Column, bits: int = BITS) -> Column:
    """Half powers of two, in order, so range filters prune."""
    return F.least(F.floor(2 * F.log2(F.greatest(c, F.lit(1)))).cast("int"), F.lit((1 << bits) - 1))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its global ``rank`` by ``order`` and the row count ``total``.

    Range partitions are sorted, numbered inside each partition and written;
    the partitions' row counts (a row each) then give each one its offset.  No
    task holds more than one range, whatever repeats: the range key ends with
    the row's own id.
    """
    part = F.shiftright(F.col("__mid"), 33)
    spread = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    spread = written(spread.withColumn("__mid", F.monotonically_increasing_id()), name)
    counts = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                            F.sum("__n").over(Window.partitionBy()).alias("total"))
    # one row per range partition: its count is the session's shuffle width at most
    out = spread.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    inside = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("rank", F.col("__before") + inside).drop("__part", "__before", "__mid")


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row of ``docs`` (doc_id, text, lang, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("__same"),
        F.struct(F.col("doc_id").cast("long").alias("first"), quantise_label(F.col("lang")).alias("a"),
                 quantise_label(F.col("source")).alias("b")).alias("__meta"))
    keys = written(keys, "shard-keys")
    first = keys.groupBy("__same").agg(F.min("__meta").alias("__first"), F.min("size").alias("__size"))
    point = [F.col("__first.a"), F.col("__first.b"), quantise_size(F.col("__size"))]
    first = first.select("__same", hilbert_index(point).alias("curve"))
    placed = ranked(keys.drop("__meta").join(first, "__same"), ["curve", "__same", "doc_id"], "shard-ranks")
    shard = F.expr(f"rank * {shards} div total").cast("int")
    start = F.expr(f"(rank * {shards} div total * total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                         (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         "curve")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read_table(spark, sf_dir, "documents"))
