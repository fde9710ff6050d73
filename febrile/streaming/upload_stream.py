"""Uploads as a file stream.

Every CSV file dropped into the watched folder is one upload: the micro-batch
is scored by the two-stage job and applied to the stores by the upload run,
inside ``foreachBatch``.  The run time is taken once per micro-batch; each one
reads the stores of the batch before it and writes a folder of its own, so a
retried micro-batch starts from the same stores.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from febrile.config import JobConfig
from febrile.plans.scoring_job import run_two_stage
from febrile.plans.upload_run import upload_to
from febrile.sources.csv_scan import na_normalised
from febrile.schemas import STORE_SCHEMAS
from febrile.session import ensure_checkpoint_dir
from febrile.sources.store import read_store, write_stores



def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def batch_folder(root: str, batch_id: int) -> str:
    """The stores after a micro-batch."""
    return f"{root.rstrip('/')}/batch-{batch_id:09d}"


def typed(batch: DataFrame, schema: T.StructType) -> DataFrame:
    text = na_normalised(batch)
    return text.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def start_upload_stream(spark: SparkSession, watch_dir: str, schema: T.StructType, store_root: str,
                        candidates: DataFrame, checkpoint_location: str, cfg: JobConfig = JobConfig(),
                        available_now: bool = False, clock: Callable[[], str] = utc_now) -> StreamingQuery:
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    source = (spark.readStream.schema(text_schema).option("header", True)
              .option("quote", '"').option("escape", '"').option("multiLine", True)
              .option("maxFilesPerTrigger", 1).csv(watch_dir))

    ensure_checkpoint_dir(spark)

    def per_upload(batch: DataFrame, batch_id: int) -> None:
        obs = typed(batch, schema)
        if cfg.order_col not in obs.columns:  # one file per micro-batch, read whole: ids follow its rows
            obs = obs.withColumn(cfg.order_col, F.monotonically_increasing_id())
        # one materialised copy in the checkpoint folder: generated ids and the
        # file contents stay fixed if an executor is lost mid-run
        obs = obs.checkpoint(eager=True)
        before, after = batch_folder(store_root, batch_id - 1), batch_folder(store_root, batch_id)
        if obs.limit(1).count() == 0:  # a header alone: the stores stay as they are
            write_stores(after, {n: read_store(spark, before, n) for n in STORE_SCHEMAS})
            return
        scored = run_two_stage(obs, cfg).scored
        upload_to(spark, before, after, scored, candidates, clock())

    writer = source.writeStream.foreachBatch(per_upload).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
