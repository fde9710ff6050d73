"""Region-keyed stores that an update rewrites in part.

A store is a parquet table below a folder, in two layers: partitions by ``slot``, a
hash of the region, and inside each slot bucket files by the engine's own hash of
the region.

* An update reads and writes only the slots that its batch touches: the old rows
  come through a partition filter, and the merged rows replace these partitions
  (dynamic overwrite).  A batch of one region costs one slot.
* Stores share the bucketing, so joins by region need no exchange.

The table's definition is made anew in each session from the folder, so any session
that sees the folder can use it.  Merged rows are checkpointed before they replace
what they were made of; a task that runs again writes the same files.  Updates of one
store follow each other: several writers at once need a table format with atomic
commits, which is not rebuilt here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.schemas import STORE_SCHEMAS
from febrile.session import ensure_checkpoint_dir

#: Partitions of a store, and bucket files of a partition.  Fixed for the life of a store.
SLOTS, BUCKETS = 64, 8
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def slot_of(region: str = "region") -> Column:
    return F.pmod(F.xxhash64(F.col(region)), F.lit(SLOTS)).cast("int")


def open_store(spark: SparkSession, root: str, name: str) -> str:
    """The table over the folder of this store; it is empty where nothing was written yet."""
    path = f"{root.rstrip('/')}/{name}"
    table = f"febrile_{name}_{hashlib.md5(path.encode()).hexdigest()[:12]}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORE_SCHEMAS[name].fields)
    # an empty folder where there is none yet
    spark.createDataFrame([], f"{fields}, slot int").write.mode("ignore").partitionBy("slot").parquet(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}, slot int) USING parquet PARTITIONED BY (slot) "
              f"CLUSTERED BY (region) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return table


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.table(open_store(spark, root, name)).drop("slot")


def lookup(spark: SparkSession, root: str, name: str, region: str) -> DataFrame:
    """Point read: one slot, one bucket, and the key reaches the scan."""
    rows = spark.table(open_store(spark, root, name))
    slot = spark.range(1).select(F.lit(region).alias("region")).select(slot_of()).first()[0]
    return rows.filter((F.col("slot") == slot) & (F.col("region") == region)).drop("slot")


def touched_slots(batch: DataFrame, region: str = "region") -> list[int]:
    """At most ``SLOTS`` numbers."""
    return sorted(r["slot"] for r in batch.filter(F.col(region).isNotNull()).select(slot_of(region).alias("slot")).distinct().collect())


def part(spark: SparkSession, root: str, name: str, slots: list[int]) -> DataFrame:
    """The rows of these slots only."""
    return spark.table(open_store(spark, root, name)).filter(F.col("slot").isin(slots)).drop("slot")


def replace(spark: SparkSession, root: str, name: str, merged: DataFrame) -> None:
    """Put ``merged``, whole slots after a merge, in place of what these slots held."""
    ensure_checkpoint_dir(spark)
    fields = STORE_SCHEMAS[name].fields
    rows = merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], slot_of().alias("slot"))
    rows = rows.repartition(BUCKETS, "region").checkpoint(eager=True)   # a bucket's rows in one task: one file a slot
    table = open_store(spark, root, name)
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def upsert(spark: SparkSession, root: str, name: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Merge ``batch`` (one row per region, or what ``merge`` reduces to that) into a store; the slots written.

    Rows without a region have no key and stay out.
    """
    batch = batch.filter(F.col("region").isNotNull())
    slots = touched_slots(batch)
    if slots:
        replace(spark, root, name, merge(part(spark, root, name, slots), batch))
    return slots
