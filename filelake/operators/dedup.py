"""Exact-duplicate detection with a choice of keeper (V3: FL1-FL8, JN1, PF1,
AG7, AG8, WN1-WN3).

Plan shape (one shuffle-aggregate + one join, both on ``(md5, size)``):

1. scan filters in the scan stage;
2. if the manifest has no ``md5``: sizes shared by >= 2 files (a partial/final
   aggregate) as a broadcast bitmap beside the content, ``md5`` map-side, and
   the narrow rows written once: content is read once and never shuffled;
3. ``groupBy(md5, size)`` with ``count`` and ``min(struct(score, path))`` --
   partial aggregation, so a group holding a third of all rows is combined
   map-side and never lands whole in one task;
4. join the groups back to their members to label ``keep`` / ``delete``:
   the group table is written once and broadcast when its row count is
   under the bound; otherwise a shuffle join, whose hot keys AQE's skew-join
   handling splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.operators import filters as FL
from filelake.session import join_side, materialize
from filelake.sources.files import hash_paths
from filelake.sources.manifest import with_md5

STRATEGIES = ("deepest", "newest", "largest")


def candidates(manifest: DataFrame, root: str, min_size: int = C.DEDUP_MIN_SIZE,
               include=None, exclude=None, skip_dirs=None) -> DataFrame:
    """Files the dedup scan keeps (FL1-FL8).  A custom ``skip_dirs`` list
    replaces the default one."""
    skip = C.DEDUP_SKIP_DIRS if skip_dirs is None else tuple(skip_dirs)
    df = P.derive(manifest, root)
    name, size = F.col("name"), F.col("size")
    from filelake.sources.manifest import prune_root, prune_skipped
    return df.filter(
        prune_root(df, root) & prune_skipped(df, root, skip)
        & P.under_root("path", root)
        & FL.min_size(size, min_size) & FL.non_empty(size)
        & FL.not_symlink(df) & FL.not_hidden(name)
        & FL.include_any(name, include) & FL.exclude_all(name, exclude)
        & FL.not_in_dirs(F.col("rel_parent"), FL.skip_regex_glob(skip))
    )


def shared_sizes(files: DataFrame) -> DataFrame:
    """Sizes held by at least two files (JN1 build side)."""
    return files.groupBy("size").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files >= 2")


SIZE_BITS = 27  # bits of the size filter: at most 2^21 words of 64, whatever the data


def size_filter(sizes: DataFrame) -> DataFrame:
    """``word``, ``bits``: a bitmap of the hashed shared sizes.  It has at most
    2^21 rows, so it can be broadcast beside content of any amount."""
    slot = F.pmod(F.xxhash64("size"), F.lit(1 << SIZE_BITS))
    s = sizes.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("_b"))
    return s.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("bits"))


def with_hashes(files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows with an md5, null where unreadable: path, size, md5 and what the
    keepers need.  Without an ``md5`` column, only rows of a shared size are
    hashed: from ``content`` (JVM ``md5``) or, for a real folder tree, by
    reading the files in chunks.  The narrow rows are written once, so no later
    branch reads or hashes content again.  ``sizes``: the shared sizes, where
    they are stored already.

    Content never crosses a shuffle: a broadcast bitmap of the shared sizes
    cuts the rows next to it, and the exact semi join runs on the narrow rows
    after hashing."""
    if "md5" not in files.columns:
        narrow = ["path", "size", *[c for c in ("name", "mtime_s", "mtime") if c in files.columns]]
        if sizes is None:
            sizes = materialize(shared_sizes(files.select("size")).select("size"), "shared-sizes")
        if "content" in files.columns:
            slot = F.pmod(F.xxhash64("size"), F.lit(1 << SIZE_BITS))
            cut = (files.select(*narrow, "content").withColumn("word", F.shiftright(slot, 6))
                   .join(F.broadcast(size_filter(sizes)), "word")
                   .where(F.expr(f"getbit(bits, cast(pmod(xxhash64(size), {1 << SIZE_BITS}) & 63 as int)) = 1")))
            files = with_md5(cut.select(*narrow, "content")).join(sizes, "size", "left_semi")
        else:
            files = hash_paths(files.select(*narrow).join(sizes, "size", "left_semi"))
        files = materialize(files, "hashed")
    return files


def hashed(files: DataFrame) -> DataFrame:
    """The readable rows of ``with_hashes``."""
    return with_hashes(files).filter(FL.readable(F.col("md5")))


def _keeper_key(strategy: str) -> Column:
    """Struct whose minimum is the keeper; ties end on the path."""
    if strategy == "newest":
        return F.struct((-F.col("mtime_s")).alias("k1"), F.col("path"))
    if strategy == "largest":
        return F.struct((-F.col("size")).alias("k1"), F.col("path"))
    if strategy != "deepest":
        raise ValueError(f"unknown keeper strategy {strategy!r}; use one of {STRATEGIES}")
    s = P.keeper_score("path", "name")
    return F.struct(s["depth"].alias("d"), s["copy_rank"].alias("c"), s["uuid_rank"].alias("u"),
                    s["parens_rank"].alias("p"), F.length("path").alias("l"), F.col("path"))


def _with_mtime(df: DataFrame) -> DataFrame:
    if "mtime_s" not in df.columns and "mtime" in df.columns:
        df = df.withColumn("mtime_s", F.unix_seconds(F.col("mtime").cast("timestamp")))
    return df


def groups(files: DataFrame, strategy: str = "deepest") -> DataFrame:
    """One row per duplicate group: md5, size, n_files, keeper_path (AG7)."""
    files = _with_mtime(files)
    return (files.groupBy("md5", "size")
                 .agg(F.count(F.lit(1)).alias("n_files"), F.min(_keeper_key(strategy)).alias("best"))
                 .filter("n_files >= 2")
                 .select("md5", "size", "n_files", F.col("best.path").alias("keeper_path")))


def dedup_plan(manifest: DataFrame, root: str, min_size: int = C.DEDUP_MIN_SIZE,
               strategy: str = "deepest", include=None, exclude=None, skip_dirs=None) -> DataFrame:
    """Plan rows for every member of a duplicate group: path, size, md5,
    keeper_path, action ('keep' / 'delete'), reason."""
    files = hashed(candidates(manifest, root, min_size, include, exclude, skip_dirs))
    # the group table is written once and broadcast when its row count allows,
    # so the members are not shuffled a second time for the join back
    members = join_side(files.select("path", "size", "md5"), groups(files, strategy), ["md5", "size"], tag="dedup-groups")
    action = F.when(F.col("path") == F.col("keeper_path"), "keep").otherwise("delete")
    return members.select(
        "path", "size", "md5", "keeper_path", action.alias("action"),
        F.lit(None).cast("string").alias("dest"),
        F.when(action == "delete", F.lit(f"duplicate ({strategy})")).otherwise(F.lit("keeper")).alias("reason"),
    )


def dedup_summary(manifest: DataFrame, root: str, min_size: int = C.DEDUP_MIN_SIZE,
                  strategy: str = "deepest", include=None, exclude=None, skip_dirs=None) -> DataFrame:
    """One row: total_files, duplicate_groups, files_to_delete, space_to_free
    (AG8) and failed_hash_files (FL14: unreadable files of a shared size, the
    ones that had to be hashed).

    All come from one pass over the rows: counts per (md5, size), unreadable
    ones among them, summed per size and then over all.  No keeper is needed, so
    ``strategy`` changes nothing here.  Where content has to be hashed, the
    counts per size that choose what to hash also give the scan total."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown keeper strategy {strategy!r}; use one of {STRATEGIES}")
    cand = candidates(manifest, root, min_size, include, exclude, skip_dirs)
    total = None
    if "md5" in cand.columns:
        files = cand
    else:
        per_size = materialize(cand.groupBy("size").agg(F.count(F.lit(1)).alias("n_files")), "sizes")
        total = per_size.select(F.sum("n_files")).scalar()
        files = with_hashes(cand, per_size.where("n_files >= 2").select("size"))
    n, copies = F.col("n"), F.when(F.col("md5").isNotNull() & (F.col("n") >= 2), F.col("n") - 1)
    per_size = (files.groupBy("md5", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("size")
                .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("md5").isNull(), n)).alias("failed"),
                     F.count(copies).alias("groups"), F.sum(copies).alias("copies")))
    nil = F.lit(0)
    return per_size.select("size", "n", "failed", "groups", "copies").agg(
        F.coalesce(F.sum("n"), nil).cast("bigint").alias("_total"),
        F.coalesce(F.sum("groups"), nil).cast("bigint").alias("duplicate_groups"),
        F.coalesce(F.sum("copies"), nil).cast("bigint").alias("files_to_delete"),
        F.coalesce(F.sum(F.col("size") * F.col("copies")), nil).cast("bigint").alias("space_to_free"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("failed"))), nil).cast("bigint").alias("failed_hash_files"),
    ).select((F.col("_total") if total is None else F.coalesce(total, nil).cast("bigint")).alias("total_files"),
             "duplicate_groups", "files_to_delete", "space_to_free", "failed_hash_files")
