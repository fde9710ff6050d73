"""Region-keyed stores as parquet tables at given paths.

Each store (``predictions``, ``region_metadata``, ``pharma_stock``) is a table
with one row per region.  The merges are DataFrame -> DataFrame; here a table is
only read from and written to a path.  An update reads one folder and writes
another one: where several writers share a store, a catalog table format with
atomic commits is the place for that, not this module.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.schemas import STORE_SCHEMAS


def empty_store(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], STORE_SCHEMAS[name])


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as it is now; one that was never written is empty."""
    try:
        return spark.read.schema(STORE_SCHEMAS[name]).parquet(os.path.join(root, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_store(spark, name)


def lookup(spark: SparkSession, root: str, name: str, region: str) -> DataFrame:
    """Point read by key; the filter reaches the parquet scan."""
    return read_store(spark, root, name).filter(F.col("region") == F.lit(region))


def write_stores(root: str, tables: dict[str, DataFrame]) -> None:
    """Write the given tables below ``root``, which must not be the folder they were read from."""
    for name, df in tables.items():
        fields = STORE_SCHEMAS[name].fields
        df.select([F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(os.path.join(root, name))
