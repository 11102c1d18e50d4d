"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends and
with A-Z in lower case; its hash is the 128 bits of the key's md5.  Documents
come in batches.  ``LineRuns`` keeps, for every key seen, in how many documents:

* a batch's keys, one row per key with its number of documents, are merge-anti-
  joined with the settled keys of the runs (those that reached ``min_docs``:
  nothing that comes later can change them), and the rest becomes a run of level
  0: a table bucketed and sorted by hash, so a join or a merge with it reads it
  in order and moves none of its rows;
* when a level has ``fan_in`` runs they are compacted into one of the next
  level: counts are summed, keys that reach ``min_docs`` become settled.

A key is common if it is settled or its counts over all runs reach ``min_docs``.
Lines of common keys are then dropped from every document: the (document,
place) rows that meet a common key are gathered per document, and only these
narrow rows meet the texts.

A hot line is counted map-side before it is shuffled; joins whose rows may share
a key go through ``session.join_side``, which splits hot keys.  Numbers of
buckets follow the number of lines.

Defined results: a document is a row; rows that share an id are told apart by
their texts, and rows equal in both are separate documents with equal results.
Null and empty texts are one empty line.  Keys shorter than ``min_chars`` code
points are never dropped.  An empty table gives no rows.  Other columns of the
input are carried along by ``drop_common_lines``, except those named like a new
one or as one of ``INNER``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.common import shared_folder, store, text_key
from filelake.session import join_side

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 8
FAN_IN = 4
BUCKETS = 8               # at least
BUCKET_KEYS = 4_000_000   # rows of a batch's keys for each further bucket
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEW = ("n_lines", "n_dropped", "kept_text")
INNER = ("_id", "_null", "_tk", "_drop")


def line_hashes(text, min_chars: int = MIN_CHARS) -> F.Column:
    """The hash of each line in order; null for keys under ``min_chars``."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)

    def hashed(line):
        key = F.btrim(line, F.lit(SPACE))
        return F.when(F.char_length(key) >= min_chars, F.md5(key.cast("binary")))
    return F.transform(lines, hashed)


class LineRuns:
    """The index: runs of (h, n, done), ``done`` being a partition of each run."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int = BUCKETS, where: str | None = None):
        self.spark, self.min_docs, self.fan_in, self.buckets = spark, min_docs, fan_in, buckets
        self.where = where or shared_folder(spark, "line-runs")
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h").write.format("parquet").option("compression", "zstd").option("path", f"{self.where}/{name}")
         .partitionBy("done").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name))
        return name

    def read(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        # lower() leaves a hash as it is; without it Spark 4.1 takes the union of bucketed scans as
        # grouped by h already, also where it then reads them unbucketed (seen: keys in two rows)
        parts = [self.read(r).select(F.lower("h").alias("h"), "n", "done") for r in runs]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        total = rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("done").alias("done"))
        return total.withColumn("done", F.col("done") | (F.col("n") >= self.min_docs))

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with h) whose key no run has settled: one merge per run."""
        for r in self.runs:
            rows = rows.join(self.read(r).where("done").select("h").hint("merge"), "h", "left_anti")
        return rows

    def add(self, keys: DataFrame) -> None:
        """One batch: ``keys`` has a row with h for each key of each document."""
        counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        new = self.unsettled(counts.repartition(self.buckets, "h"))
        self._place(0, self._write(new.select("h", "n", (F.col("n") >= self.min_docs).alias("done"))))

    def _place(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(runs))
            self._forget(runs)
            self._place(level + 1, merged)

    def _forget(self, runs: list[str]) -> None:
        for r in runs:  # the tables' names; their files stay below the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")

    def common(self) -> DataFrame:
        """h of every key in ``min_docs`` documents, written."""
        if not self.runs:
            return self.spark.createDataFrame([], "h string")
        return store(self._merged(self.runs).where("done").select("h"), "common-lines")

    def close(self) -> None:
        self._forget(self.runs)
        self.levels = []


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                      fan_in: int = FAN_IN) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others), then n_lines (long),
    n_dropped (long) and kept_text."""
    spark = docs.sparkSession
    docs = docs.drop(*NEW, *INNER)
    number = F.col("doc_id").cast("long")
    key = {"_null": number.isNull(), "_id": F.coalesce(number, F.lit(0)), "_tk": text_key(F.col("text"))}
    batch = F.pmod(F.xxhash64("_null", "_id", "_tk"), F.lit(batches)).cast("int").alias("batch")
    where = shared_folder(spark, "line-keys")
    narrow = docs.select(*[v.alias(k) for k, v in key.items()], line_hashes(F.col("text"), min_chars).alias("hs"))
    narrow.select("*", batch).write.option("compression", "zstd").partitionBy("batch").parquet(where)
    narrow = spark.read.schema(narrow.select("*", batch).schema).parquet(where)

    lines = narrow.agg(F.sum(F.size("hs").cast("long"))).first()[0] or 0
    runs = LineRuns(spark, min_docs, fan_in, max(BUCKETS, -(-lines // (BUCKET_KEYS * batches))))
    for b in range(batches):
        keys = narrow.where(F.col("batch") == b).select(F.explode(F.array_distinct("hs")).alias("h"))
        runs.add(keys.where("h is not null"))
    common = runs.common()
    runs.close()

    places = narrow.select("_null", "_id", "_tk", F.posexplode("hs").alias("at", "h")).where("h is not null")
    hits = join_side(places, common, ["h"], tag="common-lines").groupBy("_null", "_id", "_tk").agg(F.collect_set("at").alias("_drop"))
    # by a shuffle at every size: how many documents have a hit follows the data
    rows = join_side(docs.withColumns(key), hits, ["_null", "_id", "_tk"], "left", "line-hits", max_rows=0)
    # the split text is bound once per document, places are looked up in it
    keep = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1), F.col("_drop"))
    kept = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), lambda parts: F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n")), 1)
    return rows.select(
        *docs.columns, F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"))


def kept_digest(dropped: DataFrame) -> DataFrame:
    return dropped.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped",
                          F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
