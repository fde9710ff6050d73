"""Exclusive prefix sums without a single-partition window.

Rows are range-partitioned on (group, order) and checkpointed, so every
partition id is a fixed slice of the order.  Per-partition totals (at most
partitions x groups rows) give each partition its offset; inside a partition
a window adds the running sum.  Input rows are normally already reduced to one
row per distinct order value, so range partitioning stays balanced even when
one value repeats a third of all raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from febrile.session import ensure_checkpoint_dir

_PID = "__pid"


def exclusive_prefix_sums(df: DataFrame, group_cols: list[str], order_cols: list[str],
                          value_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Add ``<v>_before`` (sum of ``v`` over rows of the same group ordered
    before this row) and ``<v>_total`` (sum over the whole group)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *group_cols, *order_cols)
                .withColumn(_PID, F.spark_partition_id())
                .checkpoint(eager=True))
    totals = ranged.groupBy(*group_cols, _PID).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group_cols)
    offsets = totals.select(*group_cols, _PID,
                            *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}")
                              for v in value_cols],
                            *[F.sum(f"__t_{v}").over(w_all).alias(f"{v}_total") for v in value_cols])
    w_in = Window.partitionBy(*group_cols, _PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(v).over(w_in), F.lit(0)).alias(f"__i_{v}") for v in value_cols])
    # offsets hold one row per (group, partition); AQE broadcasts them when the
    # measured size is small and falls back to a sort-merge join otherwise
    joined = inner.join(offsets, [*group_cols, _PID])
    return joined.select(*df.columns, *[(F.col(f"__o_{v}") + F.col(f"__i_{v}")).alias(f"{v}_before")
                                        for v in value_cols],
                         *[f"{v}_total" for v in value_cols])
