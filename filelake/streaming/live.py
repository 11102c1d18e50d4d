"""Streaming forms of two batch operators.

* ``pending_ops_stream``: op-log rows arriving as files -> each op's latest
  status (``max_by`` over (seq, ts)), kept in the state store; output mode
  'update' emits only ops whose latest status changed.
* ``extension_totals_stream``: inventory rows arriving as files -> file
  count and bytes per extension (the snapshot's by-extension facet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.plans.oplog import OP_LOG_SCHEMA


def pending_ops_stream(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame: op_id, status (latest), is_pending."""
    reader = spark.readStream.schema(OP_LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = reader.parquet(log_dir)
    latest = log.groupBy("op_id").agg(F.max_by("status", F.struct("seq", "ts")).alias("status"))
    return latest.withColumn("is_pending", F.col("status") != "done")


def extension_totals_stream(spark: SparkSession, inventory_dir: str, schema: str) -> DataFrame:
    """Streaming DataFrame: ext, count, size_bytes over all inventory rows seen."""
    inv = spark.readStream.schema(schema).parquet(inventory_dir)
    return (inv.select(P.ext_of(P.name_of("path")).alias("ext"), "size")
               .groupBy("ext").agg(F.count(F.lit(1)).alias("count"),
                                   F.sum("size").cast("bigint").alias("size_bytes")))
