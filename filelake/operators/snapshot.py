"""Inventory snapshot and snapshot-to-snapshot difference (V1, V2: FL9,
AG1-AG5, TK1, AG13, JN6).

A snapshot is a set of lazy facets over one narrow projection
(path, size, ext, top) of the manifest; each facet is an aggregation with
map-side partial combine.  The nested one-row record (for JSON) is built
from the facets only when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.functions.fmt import size_text_signed
from filelake.operators import filters as FL
from filelake.sources.manifest import directories_of, prune_root, prune_skipped


def _files_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("is_dir"), F.lit(False))) if "is_dir" in df.columns else df


def snapshot_files(manifest: DataFrame, root: str, skip_dirs=None) -> DataFrame:
    """Files the snapshot walk sees: under root, not inside a skipped folder
    (exact names; an empty list means the defaults)."""
    skip = tuple(skip_dirs) if skip_dirs else C.SNAPSHOT_SKIP_DIRS
    df = _files_only(manifest)
    name = P.name_of("path")
    rp = P.rel_parent("path", root)
    return (df.filter(prune_root(df, root) & prune_skipped(df, root, skip)
                      & P.under_root("path", root) & FL.not_in_dirs(rp, FL.skip_regex_exact(skip)))
              .select("path", "size", P.ext_of(name).alias("ext"), P.top_of("path", root).alias("top")))


def by_extension(files: DataFrame) -> DataFrame:
    """AG1: ext, count, size_bytes (largest first when ordered)."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("count"),
                                    F.sum("size").cast("bigint").alias("size_bytes"))


def samples(files: DataFrame, max_samples: int = C.MAX_SAMPLES) -> DataFrame:
    """AG2: up to ``max_samples`` sample paths per extension (smallest paths).
    ``row_number() <= k`` is planned with a per-partition group limit before
    the shuffle, so a huge extension ships at most k rows per partition."""
    w = Window.partitionBy("ext").orderBy("path")
    return (files.select("ext", "path", F.row_number().over(w).alias("sample_rank"))
                 .filter(F.col("sample_rank") <= max_samples))


def top_dirs(files: DataFrame, root: str, all_dirs: DataFrame, skip_dirs=None) -> DataFrame:
    """AG3: bytes and file count per first-level folder, subtree-inclusive;
    first-level folders with nothing counted appear with zeros.  One union +
    one aggregation, no join."""
    skip = tuple(skip_dirs) if skip_dirs else C.SNAPSHOT_SKIP_DIRS
    rel = P.rel_path("path", root)
    first_level = (all_dirs.select(rel.alias("top"))
                           .filter(F.col("top").isNotNull() & ~F.col("top").contains("/")
                                   & (F.col("top") != "") & ~F.col("top").isin(list(skip)))
                           .select("top", F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("n")))
    counted = files.filter(F.col("top").isNotNull()).select("top", "size", F.lit(1).alias("n"))
    return (counted.unionByName(first_level).groupBy("top")
                   .agg(F.sum("size").cast("bigint").alias("size_bytes"),
                        F.sum("n").cast("bigint").alias("file_count")))


def largest(files: DataFrame, n: int = C.LARGEST_FILES) -> DataFrame:
    """TK1: the n largest files (ties by path); a TakeOrderedAndProject, i.e.
    a per-partition top-n merged on the driver side of the plan."""
    top = files.orderBy(F.col("size").desc(), F.col("path")).limit(n)
    w = Window.orderBy(F.col("size").desc(), F.col("path"))
    return top.select(F.row_number().over(w).alias("rank"), "path", F.col("size").alias("size_bytes"))


def summary(files: DataFrame, all_dirs: DataFrame, root: str) -> DataFrame:
    """AG4/AG5: total_files, total_dirs (every folder below root, skip list
    not applied), total_size_bytes."""
    below = all_dirs.filter(P.under_root("path", root)).select("path").distinct()
    n_dirs = below.select(F.count(F.lit(1))).scalar()
    return files.agg(F.count(F.lit(1)).alias("total_files"),
                     F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size_bytes")) \
                .select("total_files", n_dirs.alias("total_dirs"), "total_size_bytes")


@dataclass
class Snapshot:
    """Lazy facets of one snapshot."""
    root: str
    files: DataFrame
    summary: DataFrame
    by_extension: DataFrame
    samples: DataFrame
    top_dirs: DataFrame
    largest: DataFrame | None

    def record(self) -> DataFrame:
        """The nested one-row snapshot (SK1 layout).  Its maps hold one entry
        per extension / first-level folder, i.e. they grow with the variety
        of names, not with the number of files."""
        ext = (self.by_extension.join(
                   self.samples.groupBy("ext").agg(
                       F.array_sort(F.collect_list(F.struct("sample_rank", "path"))).alias("s")),
                   "ext", "left")
               .select(F.struct("ext", F.struct(
                   "count", "size_bytes",
                   F.coalesce(F.transform("s", lambda x: x["path"]),
                              F.array().cast("array<string>")).alias("sample_paths"))).alias("e")))
        ext_map = ext.agg(F.map_from_entries(F.collect_list("e")).alias("by_extension"))
        top_map = self.top_dirs.agg(F.map_from_entries(F.collect_list(F.struct(
            "top", F.struct("size_bytes", "file_count")))).alias("top_level_dirs"))
        largest = (self.largest if self.largest is not None
                   else self.files.limit(0).select(F.lit(0).alias("rank"), "path", F.col("size").alias("size_bytes")))
        big = largest.agg(F.array_sort(F.collect_list(F.struct("rank", "path", "size_bytes"))).alias("l")) \
                     .select(F.transform("l", lambda x: F.struct(x["path"].alias("path"),
                                                              x["size_bytes"].alias("size_bytes"))).alias("largest_files"))
        return (self.summary.select(F.struct("total_files", "total_dirs", "total_size_bytes").alias("summary"))
                .select(F.lit(self.root).alias("path"),
                        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                        "summary",
                        ext_map.select("by_extension").scalar().alias("by_extension"),
                        top_map.select("top_level_dirs").scalar().alias("top_level_dirs"),
                        big.select("largest_files").scalar().alias("largest_files")))


def snapshot(manifest: DataFrame, root: str, skip_dirs=None, max_samples: int = C.MAX_SAMPLES,
             quick: bool = False, dirs: DataFrame | None = None) -> Snapshot:
    """V1.  ``dirs`` are explicit folder rows (path); without them folders are
    derived from the manifest paths.  ``quick`` leaves out the largest files."""
    files = snapshot_files(manifest, root, skip_dirs)
    if dirs is None:
        dirs = directories_of(_files_only(manifest), root).select("path")
        if "is_dir" in manifest.columns:  # explicit folder rows, empty ones included
            dirs = dirs.unionByName(manifest.filter(F.col("is_dir")).select("path"))
    return Snapshot(root, files, summary(files, dirs, root), by_extension(files),
                    samples(files, max_samples), top_dirs(files, root, dirs, skip_dirs),
                    None if quick else largest(files))


# --- difference (V2) ----------------------------------------------------------

def ext_changes(current: Snapshot, previous: Snapshot) -> DataFrame:
    """JN6: extensions new in the current snapshot (with current count) or
    gone from it (with previous count)."""
    cur = current.by_extension.select("ext", F.col("count").alias("cur_count"))
    prev = previous.by_extension.select("ext", F.col("count").alias("prev_count"))
    j = cur.join(prev, "ext", "full_outer")
    return j.filter(F.col("cur_count").isNull() | F.col("prev_count").isNull()).select(
        "ext",
        F.when(F.col("prev_count").isNull(), "new").otherwise("removed").alias("change"),
        F.coalesce("cur_count", "prev_count").alias("count"))


def snapshot_diff(current: Snapshot, previous: Snapshot, with_map: bool = True) -> DataFrame:
    """AG13: one row -- files_added / files_removed are net counts, size
    change, new and removed extension counts, the summary sentence and, unless
    ``with_map`` is off, the new-extension map.  The map has an entry per new
    extension in one row; ``ext_changes`` gives the same as rows."""
    ch = ext_changes(current, previous)
    # one struct-valued scalar subquery per input instead of one per field
    prev = previous.summary.select(F.struct("total_files", "total_size_bytes")).scalar()
    new_map = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("change") == "new", F.struct("ext", "count")))))
    changes = ch.agg(F.struct(
        F.count_if(F.col("change") == "new").alias("n_new"),
        F.count_if(F.col("change") == "removed").alias("n_removed"),
        *([new_map.alias("new_map")] if with_map else []))).scalar()
    delta = F.col("total_files") - prev["total_files"]
    out = current.summary.select(
        F.greatest(delta, F.lit(0)).cast("bigint").alias("files_added"),
        F.greatest(-delta, F.lit(0)).cast("bigint").alias("files_removed"),
        (F.col("total_size_bytes") - prev["total_size_bytes"]).cast("bigint").alias("size_change_bytes"),
        changes["n_new"].cast("bigint").alias("new_extensions"),
        changes["n_removed"].cast("bigint").alias("removed_extensions"),
        *([changes["new_map"].alias("new_extension_counts")] if with_map else []))
    parts = F.concat_ws(", ",
                        F.when(F.col("files_added") > 0, F.format_string("+%d files", "files_added")),
                        F.when(F.col("files_removed") > 0, F.format_string("-%d files", "files_removed")),
                        F.when(F.col("new_extensions") > 0, F.format_string("%d new extensions", "new_extensions")),
                        F.when(F.col("removed_extensions") > 0,
                               F.format_string("%d removed extensions", "removed_extensions")),
                        F.when(F.col("size_change_bytes") != 0,
                               F.concat(size_text_signed(F.col("size_change_bytes")), F.lit(" change"))))
    return out.withColumn("summary", F.when(parts == "", "No changes").otherwise(parts))
