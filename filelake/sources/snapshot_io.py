"""Snapshot JSON in and out (SR3, SK1, SK2).

Two layouts.  A document is one JSON object, as other tools read it; its maps
have an entry per extension and first-level folder, all in one row.  A sharded
snapshot is a folder of JSON lines that Spark writes and reads in parallel,
however many names there are:

    by_extension/    ext, count, size_bytes, sample_paths (a few), in ranges of ext
    top_level_dirs/  top, size_bytes, file_count, in ranges of top
    largest_files/   rank, path, size_bytes
    header/          path, timestamp, summary; written last: what has one is whole

``document_lines`` streams a sharded snapshot as one document, row by row.  A sharded
difference has a header and ``extensions/`` (ext, change, count).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = """
  path STRING, timestamp STRING,
  summary STRUCT<total_files: BIGINT, total_dirs: BIGINT, total_size_bytes: BIGINT>,
  by_extension MAP<STRING, STRUCT<count: BIGINT, size_bytes: BIGINT, sample_paths: ARRAY<STRING>>>,
  top_level_dirs MAP<STRING, STRUCT<size_bytes: BIGINT, file_count: BIGINT>>,
  largest_files ARRAY<STRUCT<path: STRING, size_bytes: BIGINT>>,
  current_timestamp STRING, previous_timestamp STRING,
  files_added BIGINT, files_removed BIGINT, size_change_bytes BIGINT,
  new_extensions MAP<STRING, BIGINT>
"""


def write_snapshot(record: DataFrame, location: str, mode: str = "overwrite") -> None:
    """SK1 / SK2: one JSON document per record row."""
    record.coalesce(1).write.mode(mode).json(location)


def read_snapshot(spark: SparkSession, location: str) -> DataFrame:
    """SR3: read previous snapshot documents, one per file.  Rows without
    ``by_extension`` are diff documents (``is_diff``): ``document`` holds the
    text as it was, ``summary_text`` its sentence."""
    raw = spark.read.option("wholetext", "true").text(location).filter(F.trim("value") != "")
    doc = raw.select(F.from_json("value", SNAPSHOT_SCHEMA).alias("s"), F.col("value").alias("document"))
    is_diff = F.get_json_object("document", "$.by_extension").isNull()
    return doc.select("s.*", is_diff.alias("is_diff"),
                      F.when(is_diff, F.get_json_object("document", "$.summary")).alias("summary_text"), "document")


def facets_from_record(record: DataFrame):
    """Exploded by-extension facet of a read snapshot record."""
    return record.select(F.explode("by_extension").alias("ext", "v")).select(
        "ext", F.col("v.count").alias("count"), F.col("v.size_bytes").alias("size_bytes"))


def snapshot_from_record(record: DataFrame, root: str):
    """A stored snapshot (one row of ``read_snapshot``) as facets again, so that
    a fresh one can be compared with it by ``snapshot_diff``."""
    from filelake.operators.snapshot import Snapshot
    samples = record.select(F.explode("by_extension").alias("ext", "v")).select(
        "ext", F.posexplode("v.sample_paths").alias("p", "path")).select("ext", "path", (F.col("p") + 1).alias("sample_rank"))
    tops = record.select(F.explode("top_level_dirs").alias("top", "v")).select("top", "v.size_bytes", "v.file_count")
    big = record.select(F.posexplode("largest_files").alias("p", "f")).select(
        (F.col("p") + 1).alias("rank"), F.col("f.path").alias("path"), F.col("f.size_bytes").alias("size_bytes"))
    return Snapshot(root, big.select("path", F.col("size_bytes").alias("size")), record.select("summary.*"),
                    facets_from_record(record), samples, tops, big)


def diff_record(diff: DataFrame, root: str | None = None, current: DataFrame | None = None,
                previous: DataFrame | None = None) -> DataFrame:
    """Snapshot difference in document layout (SK2): the new-extension map
    under ``new_extensions``, counts of added / removed files, size change, the
    summary sentence and, of the two records when given, their timestamps."""
    stamps = [r.select("timestamp").scalar().alias(n) for r, n in
              ((current, "current_timestamp"), (previous, "previous_timestamp")) if r is not None]
    return diff.select(
        *([F.lit(root).alias("path")] if root else []), *stamps,
        "files_added", "files_removed", "size_change_bytes",
        F.col("new_extension_counts").alias("new_extensions"), "summary")


# --- sharded layout ------------------------------------------------------------------

FACETS = {"by_extension": "ext STRING, count BIGINT, size_bytes BIGINT, sample_paths ARRAY<STRING>",
          "top_level_dirs": "top STRING, size_bytes BIGINT, file_count BIGINT",
          "largest_files": "rank INT, path STRING, size_bytes BIGINT"}
HEADER = "path STRING, timestamp STRING, summary STRUCT<total_files: BIGINT, total_dirs: BIGINT, total_size_bytes: BIGINT>"
CHANGES = "ext STRING, change STRING, count BIGINT"


def _ranges(rows: DataFrame, key: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, key).sortWithinPartitions(key)


def _stamp():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")


def write_sharded(snap, location: str) -> None:
    """SK1, sharded.  Only an extension's own few samples are put into one row."""
    at = location.rstrip("/")
    few = snap.samples.groupBy("ext").agg(F.array_sort(F.collect_list(F.struct("sample_rank", "path"))).alias("s"))
    ext = snap.by_extension.join(few, "ext", "left").select(
        "ext", "count", "size_bytes", F.coalesce(F.transform("s", lambda x: x["path"]), F.array().cast("array<string>")).alias("sample_paths"))
    _ranges(ext, "ext").write.json(f"{at}/by_extension")
    _ranges(snap.top_dirs, "top").write.json(f"{at}/top_level_dirs")
    big = snap.largest if snap.largest is not None else snap.files.limit(0).select(F.lit(0).alias("rank"), "path", F.col("size").alias("size_bytes"))
    big.coalesce(1).sortWithinPartitions("rank").write.json(f"{at}/largest_files")  # as many as were asked for
    total = F.struct("total_files", "total_dirs", "total_size_bytes").alias("summary")
    snap.summary.select(F.lit(snap.root).alias("path"), _stamp(), total).coalesce(1).write.json(f"{at}/header")


def read_sharded(spark: SparkSession, location: str):
    """The snapshot of a sharded folder, as facets."""
    from filelake.operators.snapshot import Snapshot
    at = location.rstrip("/")
    ext, tops, big = (spark.read.schema(kinds).json(f"{at}/{name}") for name, kinds in FACETS.items())
    head = spark.read.schema(HEADER).json(f"{at}/header")
    few = ext.select("ext", F.posexplode("sample_paths").alias("p", "path")).select("ext", "path", (F.col("p") + 1).alias("sample_rank"))
    return Snapshot(head.first()["path"], big.select("path", F.col("size_bytes").alias("size")), head.select("summary.*"),
                    ext.drop("sample_paths"), few, tops, big)


def document_lines(spark: SparkSession, location: str) -> Iterator[str]:
    """A sharded snapshot as the text of one document, piece by piece: rows
    come to the reader a partition at a time, never all at once."""
    at = location.rstrip("/")
    head = spark.read.schema(HEADER).json(f"{at}/header").first().asDict(recursive=True)
    yield json.dumps(head, ensure_ascii=False)[:-1]
    for name, kinds in FACETS.items():
        rows = spark.read.schema(kinds).json(f"{at}/{name}")
        yield f', "{name}": ' + ("[" if name == "largest_files" else "{")
        if name == "largest_files":
            rows = rows.orderBy("rank").drop("rank")
        for i, r in enumerate(rows.toLocalIterator()):
            d = r.asDict()
            key = d.pop("ext", d.pop("top", None)) if name != "largest_files" else None
            yield (", " if i else "") + ("" if name == "largest_files" else json.dumps(key, ensure_ascii=False) + ": ") + json.dumps(d, ensure_ascii=False)
        yield "]" if name == "largest_files" else "}"
    yield "}"


def write_sharded_diff(diff: DataFrame, changes: DataFrame, location: str) -> None:
    """SK2, sharded: ``snapshot_diff`` (without its map) and ``ext_changes``."""
    at = location.rstrip("/")
    _ranges(changes, "ext").write.json(f"{at}/extensions")
    diff.drop("new_extension_counts").withColumn("timestamp", _stamp()).coalesce(1).write.json(f"{at}/header")


def read_sharded_diff(spark: SparkSession, location: str) -> tuple[DataFrame, DataFrame]:
    at = location.rstrip("/")
    kinds = "files_added BIGINT, files_removed BIGINT, size_change_bytes BIGINT, new_extensions BIGINT, removed_extensions BIGINT, summary STRING, timestamp STRING"
    return spark.read.schema(kinds).json(f"{at}/header"), spark.read.schema(CHANGES).json(f"{at}/extensions")
