"""Clean verb (V5, V6, V11, V13): junk files, empty folders, permissions.

Empty folders are found in closed form instead of repeated passes: a folder
goes iff nothing that stays (a surviving file or a protected folder) lies
below it and its height (deepest folder chain under it) is below the number
of passes.  The chains of distinct folders are exploded, never those of every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.operators import filters as FL
from filelake.sources.manifest import ancestor_rows, directories_of, folders_above


def _files(manifest: DataFrame) -> DataFrame:
    if "is_dir" in manifest.columns:
        return manifest.filter(~F.coalesce(F.col("is_dir"), F.lit(False)))
    return manifest


def junk_plan(manifest: DataFrame, root: str, patterns=None,
              protected=C.CLEAN_PROTECTED) -> DataFrame:
    """V5: files outside protected folders whose name matches a junk glob
    (defaults plus ``patterns``): path, size, action 'delete'."""
    return (_files(manifest).filter(junk_predicate(root, patterns, protected))
              .select("path", "size", F.lit("delete").alias("action"),
                      F.lit(None).cast("string").alias("dest"), F.lit("junk").alias("reason")))


def junk_predicate(root: str, patterns=None, protected=C.CLEAN_PROTECTED) -> "F.Column":
    """Row predicate of ``junk_plan``: removing junk is a filter, no join."""
    name = P.name_of("path")
    rp = P.rel_parent("path", root)
    return P.under_root("path", root) & FL.not_protected(rp, protected) & FL.is_junk(name, patterns)


def without_junk(manifest: DataFrame, root: str, patterns=None) -> DataFrame:
    """The manifest after ``junk_plan`` is applied (same rows as
    ``apply_plan(manifest, junk_plan(...))``, as a filter)."""
    return manifest.filter(~F.coalesce(junk_predicate(root, patterns), F.lit(False)))


def _protected_dir(path, root: str, protected) -> "F.Column":
    """A folder is protected when one of its names below root contains a
    protected string (its own name included)."""
    rel = P.rel_path(path, root)
    return F.coalesce(P.dir_contains_any(rel, protected), F.lit(False))


def removable_dirs(dirs: DataFrame, files: DataFrame, root: str, max_passes: int = C.EMPTY_DIR_MAX_PASSES,
                   protected=C.CLEAN_PROTECTED) -> DataFrame:
    """V6: folders (``dirs.path``, at or below root) that repeated passes of
    empty-folder removal would delete: path.  A folder that could not be read
    (``dirs.error``) may hold files: it stays, and all above it.

    One aggregation by folder: what it is (a candidate, protected, above
    something that stays, above a chain of ``max_passes`` folders) comes as flags.
    A folder whose height is ``max_passes`` or more is some folder's
    ``max_passes``-th ancestor, so heights need no chains."""
    r = P.norm_root(root) or "/"
    unread = F.col("error").isNotNull() if "error" in dirs.columns else F.lit(False)
    d = dirs.select("path", unread.alias("_unread")).filter((F.col("path") == r) | P.under_root("path", root))
    stay = _protected_dir(F.col("path"), root, protected) | F.col("_unread")
    d = d.select("path", F.when(stay, 3).otherwise(1).alias("_flag"))
    # anything that stays blocks all of its ancestors
    blocked = folders_above(files.select("path").filter(P.under_root("path", root)).unionByName(d.where("_flag = 3").select("path")), root)
    n = P.depth_of("path")
    far = F.expr("substring_index(path, '/', _n)")
    deep = d.where("path <> '/'").select("path", (n - max_passes).alias("_n")).where("_n > 0").select(F.when(far == "", "/").otherwise(far).alias("path"))
    flags = d.unionByName(blocked.withColumn("_flag", F.lit(2))).unionByName(deep.withColumn("_flag", F.lit(2)))
    return flags.groupBy("path").agg(F.bit_or("_flag").alias("_flag")).where("_flag = 1").select("path")


def empty_dirs_plan(dirs: DataFrame, files: DataFrame, root: str,
                    max_passes: int = C.EMPTY_DIR_MAX_PASSES,
                    protected=C.CLEAN_PROTECTED) -> DataFrame:
    """V6 as a plan: path, action 'rmdir', height (0: no folder below).  What
    lies below a removable folder is removable too, so heights are taken among
    those alone."""
    gone = removable_dirs(dirs, files, root, max_passes, protected)
    height = ancestor_rows(gone, root, include_self=True).groupBy("anc").agg(F.max("up").alias("height"))
    return (gone.join(height.withColumnRenamed("anc", "path"), "path")
            .select("path", F.lit("rmdir").alias("action"), "height"))


def fixed_mode(entries: DataFrame) -> "F.Column":
    """mode | 0644 | (folder or any x bit ? 0111 : 0)."""
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in entries.columns else F.lit(False)
    mode = F.col("mode")
    x = F.when(is_dir | (mode.bitwiseAND(0o111) != 0), F.lit(0o111)).otherwise(F.lit(0))
    return mode.bitwiseOR(F.lit(0o644)).bitwiseOR(x)


def with_permissions(manifest: DataFrame, root: str, uid: int | None = None, gid: int | None = None) -> DataFrame:
    """The manifest with the modes and owners ``permission_plan`` sets below root."""
    below = P.under_root("path", root) | (F.col("path") == (P.norm_root(root) or "/"))
    new = {"mode": fixed_mode(manifest)} if "mode" in manifest.columns else {}
    new |= {c: F.lit(v) for c, v in (("uid", uid), ("gid", gid)) if v is not None and c in manifest.columns}
    known = F.col("mode").isNotNull() if "mode" in manifest.columns else F.lit(False)
    return manifest.withColumns({c: F.when(below & known, v).otherwise(F.col(c)) for c, v in new.items()})


def permission_plan(entries: DataFrame, uid: int | None = None, gid: int | None = None) -> DataFrame:
    """V11: rows whose mode (or owner) differs from ``u+rwX,go+rX`` (and the
    requested owner): new mode = mode | 0644 | (folder or any x bit ? 0111 : 0)."""
    mode, new_mode = F.col("mode"), fixed_mode(entries)
    out = entries.filter(mode.isNotNull()).select("path", mode.alias("mode"), new_mode.alias("new_mode"),
                                                  *([F.col("uid")] if "uid" in entries.columns else []),
                                                  *([F.col("gid")] if "gid" in entries.columns else []))
    differs = F.col("mode") != F.col("new_mode")
    if uid is not None:
        out = out.withColumn("new_uid", F.lit(uid))
        differs = differs | (~F.col("uid").eqNullSafe(F.lit(uid)) if "uid" in out.columns else F.lit(True))
    if gid is not None:
        out = out.withColumn("new_gid", F.lit(gid))
        differs = differs | (~F.col("gid").eqNullSafe(F.lit(gid)) if "gid" in out.columns else F.lit(True))
    return out.filter(differs).withColumn("action", F.lit("chmod"))


def permission_plan_ntfs(entries: DataFrame, uid: int = C.NTFS_DEFAULT_ID,
                         gid: int = C.NTFS_DEFAULT_ID) -> DataFrame:
    """V11, external-drive form: owner defaults to 1000:1000."""
    return permission_plan(entries, uid, gid)


def clean_plan(manifest: DataFrame, root: str, dirs: DataFrame | None = None, junk: bool = False,
               empty_dirs: bool = False, permissions: bool = False, patterns=None,
               uid: int | None = None, gid: int | None = None,
               max_passes: int = C.EMPTY_DIR_MAX_PASSES) -> DataFrame:
    """V13: no flag -> all three; custom patterns alone imply junk.  Junk is
    planned first, so folders holding only junk empty out.  Rows: path,
    action (delete / rmdir / chmod), size, and what a chmod row sets: new_mode,
    new_uid, new_gid.  Folder rows of the manifest (``is_dir``) that stay get
    their permissions too; a manifest without ``mode`` has no chmod rows."""
    apply_all = not (junk or empty_dirs or permissions or patterns)
    files = _files(manifest).filter(P.under_root("path", root))
    parts = []
    survivors = files
    if apply_all or junk or patterns:
        j = junk_plan(files, root, patterns)
        parts.append(j.select("path", "action", "size"))
        survivors = without_junk(files, root, patterns)
    if apply_all or empty_dirs:
        if dirs is None:
            dirs = directories_of(files, root)
            if "is_dir" in manifest.columns:  # folder rows, empty and unreadable ones among them
                dirs = dirs.select("path").unionByName(manifest.filter("is_dir").select("path", *[c for c in ("error",) if c in manifest.columns]),
                                                       allowMissingColumns=True)
        parts.append(removable_dirs(dirs, survivors, root, max_passes)
                     .select("path", F.lit("rmdir").alias("action"), F.lit(None).cast("bigint").alias("size")))
    if apply_all or permissions:
        entries = survivors
        if "is_dir" in manifest.columns:
            folders = manifest.filter(F.col("is_dir") & (P.under_root("path", root) | (F.col("path") == (P.norm_root(root) or "/"))))
            for p in parts:
                folders = folders.join(p.filter(F.col("action") == "rmdir").select("path"), "path", "left_anti")
            entries = survivors.unionByName(folders.select(*survivors.columns))
        if "mode" in entries.columns:
            fix = permission_plan(entries, uid, gid)
            parts.append(fix.withColumns({c: F.lit(None).cast("int") for c in ("new_uid", "new_gid") if c not in fix.columns})
                            .select("path", "action", F.lit(None).cast("bigint").alias("size"), "new_mode", "new_uid", "new_gid"))
    schema = "path string, action string, size bigint, new_mode int, new_uid int, new_gid int"
    out = manifest.sparkSession.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def clean_summary(plan: DataFrame) -> DataFrame:
    """AG11: junk_deleted, junk_size, dirs_removed, permissions_to_fix."""
    a = F.col("action")
    return plan.agg(F.count_if(a == "delete").alias("junk_deleted"),
                    F.coalesce(F.sum(F.when(a == "delete", F.col("size"))), F.lit(0)).cast("bigint").alias("junk_size"),
                    F.count_if(a == "rmdir").alias("dirs_removed"),
                    F.count_if(a == "chmod").alias("permissions_to_fix"))
