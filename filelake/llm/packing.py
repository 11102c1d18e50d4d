"""Packing with optimal length buckets.

Texts are cut into pieces of at most ``max_len`` tokens.  The global histogram
of piece lengths (at most ``max_len`` rows) goes to the driver, where dynamic
programming chooses the ``buckets`` upper bounds that minimise the padding over
all pieces.  Inside a bucket pieces are put into an order by hash and every
``budget // bound`` of them form a batch, so that a padded batch holds at most
``budget`` tokens.

The order needs no single task: rows are range-partitioned by (bucket, hash,
ids) and written, each partition knows its rows' places, and the counts per
partition and bucket give the offsets.

Defined results: a text without tokens gives one row with n_tokens 0 and no
bucket or batch; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import by_value, small_batches, store

by_value(__name__)

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 65_536


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n: words between ASCII white space."""

    def run(batches):
        for batch in batches:
            n = [len(t.split()) if t else 0 for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return (small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_t"))
            .mapInArrow(run, "doc_id long, n long"))


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` bounds that minimise the sum of bound - length; of
    equally good ones the fewest."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    count = np.array([histogram[s] for s in sizes.tolist()], np.float64)
    c, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    m = len(sizes)
    # cost[j]: least padding of the first j sizes; the last bucket is (i, j]
    cost, back = np.full(m + 1, np.inf), []
    cost[0] = 0
    best = None
    for _ in range(min(buckets, m)):
        new, frm = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            t = cost[:j] + sizes[j - 1] * (c[j] - c[:j]) - (total[j] - total[:j])
            frm[j] = int(np.argmin(t))
            new[j] = t[frm[j]]
        back.append(frm)
        if best is None or new[m] < best[0]:
            best = (new[m], len(back))
        cost = new
    out, j = [], m
    for frm in reversed(back[:best[1]]):
        out.append(int(sizes[j - 1]))
        j = int(frm[j])
    return out[::-1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket_len, padding,
    batch_id (bucket and number in it), slot (place in the batch)."""
    n = store(lengths(docs), "lengths")
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / max_len), F.lit(0)).cast("int")))
    piece = (n.select("doc_id", "n", cut.alias("piece"))
             .withColumn("start", F.col("piece").cast("long") * max_len)
             .withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(max_len).cast("long"))))
    histogram = {r["n_tokens"]: r["c"] for r in
                 piece.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    bounds = best_bounds(histogram, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    rows = (piece.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, bucket))
            .withColumn("_h", F.xxhash64("doc_id", "piece")))
    order = ["bucket_len", "_h", "doc_id", "piece", "n_tokens"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    placed = store(placed, "placed")
    count = placed.groupBy("bucket_len", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("bucket_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = store(count.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                   .select("_part", F.col("bucket_len").alias("_b"), (F.col("_before") - F.col("_from")).alias("_shift")), "offsets")
    ranked = placed.join(offset, (placed["_part"] == offset["_part"]) & placed["bucket_len"].eqNullSafe(offset["_b"]), "left")
    rank, room = F.col("_at") + F.col("_shift"), F.floor(F.lit(budget) / F.col("bucket_len"))
    room = F.greatest(room, F.lit(1))
    batch = F.when(F.col("bucket_len").isNotNull(), F.concat(
        F.col("bucket_len").cast("string"), F.lit("-"), F.floor(rank / room).cast("string")))
    return ranked.select("doc_id", "piece", "start", "n_tokens", "bucket_len",
                         (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
                         batch.alias("batch_id"), F.when(F.col("bucket_len").isNotNull(), F.pmod(rank, room).cast("int")).alias("slot"))
