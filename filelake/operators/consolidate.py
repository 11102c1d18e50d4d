"""Merge one folder tree into another without storing content twice (V8:
FL1, FL10, FL12, FL14, PF19, PF20, JN2, JN3, JN7, AG12, SO2).

One pass: the distinct (md5, size) keys held inside the target are joined
(left) to the files outside it -- a hit is a duplicate to ``delete``, a miss
is ``move``d into ``<target>/_STAGING/_from_<source folder>/`` under a
collision-free name.  Files below a ``_staging`` folder do not count as in
the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.functions.fmt import size_text
from filelake.operators import filters as FL
from filelake.operators.collide import assign_slots
from filelake.session import join_side, materialize, materialize_counted
from filelake.sources.manifest import ensure_md5, prune_root, prune_skipped


def in_target(path: Column, target: str) -> Column:
    """PF20: case-insensitive prefix ``target/``, and no '_staging' part."""
    low = F.lower(path)
    return low.startswith(P.norm_root(target).lower() + "/") & ~F.array_contains(F.split(low, "/"), "_staging")


def staging_subdir(path: Column, source: str) -> Column:
    """PF19: '_from_<parent>', '_from_<grandparent>_<parent>' for generic
    parents (source / files / data) with >= 3 parts, '_from_root' for files
    directly in the source (or outside it)."""
    rel = P.rel_path(path, source)
    parts = F.split(rel, "/")
    n = F.size(parts)
    parent = F.element_at(parts, -2)
    grand = F.element_at(parts, -3)
    named = (F.when(parent.isin(list(C.GENERIC_PARENTS)) & (n >= 3),
                    F.concat(F.lit("_from_"), grand, F.lit("_"), parent))
              .otherwise(F.concat(F.lit("_from_"), parent)))
    return F.when(rel.isNotNull() & (n >= 2), named).otherwise(F.lit("_from_root"))


def scan(manifest: DataFrame, source: str, target: str, min_size: int = C.CONSOLIDATE_MIN_SIZE,
         file_type: str = "all", skip_dirs=C.CONSOLIDATE_SKIP_DIRS) -> DataFrame:
    """Files of the source walk that match the preset and size, with the
    in-target flag; ``md5`` NULL rows are the failed hashes."""
    df = manifest
    if "is_dir" in df.columns:
        df = df.filter(~F.coalesce(F.col("is_dir"), F.lit(False)))
    name = P.name_of("path")
    rp = P.rel_parent("path", source)
    matched = df.filter(prune_root(df, source) & prune_skipped(df, source, skip_dirs)
                        & P.under_root("path", source)
                        & FL.not_in_dirs(rp, FL.skip_regex_prefix(skip_dirs))
                        & FL.ext_in_preset(P.ext_of(name), file_type)
                        & FL.min_size(F.col("size"), min_size))
    # every matching file is compared (the tool hashes them all): hash here
    # when the manifest has no md5, after the cheap filters
    matched = ensure_md5(matched.select("path", "size", *[x for x in ("md5", "content") if x in df.columns]))
    return matched.select("path", "size", "md5", name.alias("name"),
                          in_target(F.col("path"), target).alias("in_target"))


def _with_target(manifest: DataFrame, target: str, target_manifest: DataFrame | None) -> DataFrame:
    """One inventory holding both trees.  ``target_manifest`` is the inventory
    of the target: its rows below the target stand for that tree, so each path
    comes from one side and no row is compared to tell."""
    if target_manifest is None:
        return manifest
    below = P.under_root("path", target)
    return manifest.filter(~below).unionByName(target_manifest.filter(below), allowMissingColumns=True)


def _files(manifest: DataFrame, source: str, target: str, min_size: int, file_type: str, skip_dirs,
           outside_target: bool) -> DataFrame:
    """The source walk, plus the target walk when the target is its own tree."""
    f = scan(manifest, source, target, min_size, file_type, skip_dirs)
    if outside_target:
        t = manifest.filter(P.under_root("path", target) & ~P.under_root("path", source))
        f = f.unionByName(scan(t, target, target, min_size, file_type, skip_dirs))
    return f


def consolidate_plan(manifest: DataFrame, source: str, target: str,
                     min_size: int = C.CONSOLIDATE_MIN_SIZE, file_type: str = "all",
                     skip_dirs=C.CONSOLIDATE_SKIP_DIRS, target_manifest: DataFrame | None = None) -> DataFrame:
    """Plan rows: path, size, md5, action ('delete' / 'move'), dest, reason.
    ``target_manifest``: inventory of a target outside the source tree."""
    if P.norm_root(source) == P.norm_root(target):
        raise ValueError("source and target cannot be the same")
    manifest = _with_target(manifest, target, target_manifest)
    return _judge(manifest, target, source, _compared(manifest, source, target, min_size, file_type, skip_dirs, target_manifest))


def _compared(manifest: DataFrame, source: str, target: str, min_size: int, file_type: str, skip_dirs,
              target_manifest: DataFrame | None) -> DataFrame:
    """The files both sides compare, hashed: written once when they had to be
    read for it."""
    files = _files(manifest, source, target, min_size, file_type, skip_dirs, target_manifest is not None)
    return files if "md5" in manifest.columns else materialize(files, "consolidate-files")


def _judge(manifest: DataFrame, target: str, source: str, files: DataFrame) -> DataFrame:
    files = files.filter(F.col("md5").isNotNull())
    keys = files.filter("in_target").select("md5", "size").distinct().withColumn("in_target_copy", F.lit(True))
    # judged once (one left join on the content key), then read by both branches
    outside, seen = materialize_counted(join_side(files.filter(~F.col("in_target")), keys, ["md5", "size"], "left", "consolidate-keys")
                                        .select("path", "size", "md5", "name",
                                                F.coalesce(F.col("in_target_copy"), F.lit(False)).alias("dup")),
                                        "consolidate", movers=F.count_if(~F.col("dup")))
    dup = F.col("dup")
    deletes = outside.filter(dup).select("path", "size", "md5", F.lit("delete").alias("action"),
                                         F.lit(None).cast("string").alias("dest"),
                                         F.lit("content already in target").alias("reason"))
    staging = P.norm_root(target) + "/_STAGING/"
    movers = (outside.filter(~dup)
                     .withColumn("dest_dir", F.concat(F.lit(staging), staging_subdir(F.col("path"), source))))
    existing = (manifest.filter(F.col("path").startswith(staging))  # pushed to the scan
                        .select(P.parent_of("path").alias("dir"), P.name_of("path").alias("name")))
    moves = assign_slots(movers, "dest_dir", "name", existing, n_movers=seen["movers"]).select(
        "path", "size", "md5", F.lit("move").alias("action"), "dest", F.lit("unique content").alias("reason"))
    return moves.unionByName(deletes)


def consolidate_summary(manifest: DataFrame, source: str, target: str,
                        min_size: int = C.CONSOLIDATE_MIN_SIZE, file_type: str = "all",
                        skip_dirs=C.CONSOLIDATE_SKIP_DIRS, target_manifest: DataFrame | None = None) -> DataFrame:
    """AG12: files_moved, files_deleted, space_organized, space_freed,
    already_in_target, failed_hash_files (planned counts)."""
    if P.norm_root(source) == P.norm_root(target):
        raise ValueError("source and target cannot be the same")
    manifest = _with_target(manifest, target, target_manifest)
    files = _compared(manifest, source, target, min_size, file_type, skip_dirs, target_manifest)
    plan = _judge(manifest, target, source, files)
    a = F.col("action")
    counts = files.agg(F.count_if(F.col("in_target") & F.col("md5").isNotNull()).alias("t"),
                       F.count_if(F.col("md5").isNull()).alias("f"))
    return plan.agg(
        F.count_if(a == "move").alias("files_moved"),
        F.count_if(a == "delete").alias("files_deleted"),
        F.coalesce(F.sum(F.when(a == "move", F.col("size"))), F.lit(0)).cast("bigint").alias("space_organized"),
        F.coalesce(F.sum(F.when(a == "delete", F.col("size"))), F.lit(0)).cast("bigint").alias("space_freed"),
    ).select("*", counts.select("t").scalar().alias("already_in_target"),
             counts.select("f").scalar().alias("failed_hash_files"),
             size_text(F.col("space_organized")).alias("space_organized_human"),
             size_text(F.col("space_freed")).alias("space_freed_human"))
