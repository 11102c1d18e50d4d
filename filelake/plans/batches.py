"""Ordered batches of a plan (SK4): row i (in path order) goes to batch
floor(i / n).

Exact global numbering without a single-partition window: range-partition
by path, sort inside each partition, take the per-partition position from
``monotonically_increasing_id`` (partition id in the high bits), and add the
partition's offset -- a running sum over one count per partition, a table
bounded by the partition count and broadcast as such.

The numbered rows are materialised before the counts are taken: range
partitioning samples its input to pick bounds, and an input whose row order
varies between runs (any shuffle output) would otherwise get different
bounds in the two branches that read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.session import materialize


def ordered_index(df: DataFrame, order_col: str = "path", partitions: int | None = None) -> DataFrame:
    """Add ``idx``: 0-based position of each row in ``order_col`` order."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = (df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    t = materialize(t.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
                     .drop("_mid"), "ordered")
    local = F.col("_local")
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # ``offsets`` has one row per partition: a proven bound, so broadcast it.
    return (t.join(F.broadcast(offsets), "_pid", "inner")
             .withColumn("idx", (F.col("_off") + local).cast("bigint"))
             .drop("_pid", "_local", "_off"))


def delete_batches(plan: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """Delete rows of a plan with ``batch_id`` (floor(idx / batch_size))."""
    d = plan.filter(F.col("action") == "delete")
    return ordered_index(d).withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("bigint"))


def write_batches(batches: DataFrame, location: str) -> None:
    """Range files in batch order with ``batch_id`` as a column, so the number
    of files follows the data's size and not the number of batches; a remover
    reads one batch by a filter that prunes files by their statistics."""
    batches.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "idx").write.mode("overwrite").parquet(location)
