"""Manifest sources (SR1, SR2).

A manifest is one row per object: ``path`` (absolute POSIX string), ``size``
(BIGINT), optional ``md5`` (hex, NULL = unreadable), ``mtime_s`` (epoch
seconds), ``is_symlink``, ``mode`` and metadata columns (``artist``,
``exif_date``).  A manifest may instead carry ``content``; the dedup verb then
hashes only the rows whose size is shared and drops the content before any
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions import paths as P


def from_inventory(spark: SparkSession, location: str, fmt: str = "parquet",
                   rename: dict[str, str] | None = None, **options) -> DataFrame:
    """Read an object-store / file inventory table and map its columns onto
    manifest names (``rename`` = {inventory column: manifest column})."""
    df = spark.read.format(fmt).options(**options).load(location)
    for src, dst in (rename or {}).items():
        df = df.withColumnRenamed(src, dst)
    if "size" in df.columns:
        df = df.withColumn("size", F.col("size").cast("bigint"))
    return df


def from_table(df: DataFrame, path_expr, content_expr=None, **columns) -> DataFrame:
    """Treat any table as a manifest: one row per object with a path
    expression and optionally a content expression (size = byte length)."""
    out = df.select(F.expr(path_expr).alias("path") if isinstance(path_expr, str) else path_expr.alias("path"),
                    *[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()],
                    *([] if content_expr is None else
                      [(F.expr(content_expr) if isinstance(content_expr, str) else content_expr).alias("content")]))
    if content_expr is not None and "size" not in columns:
        out = out.withColumn("size", F.octet_length("content").cast("bigint"))
    return out


def from_files(spark: SparkSession, root: str, min_size: int | None = None) -> DataFrame:
    """List a real folder tree, folders included (see ``sources.files.list_tree``);
    ``min_size`` keeps files of that size and all folders."""
    from filelake.sources.files import list_tree
    df = list_tree(spark, root)
    return df if min_size is None else df.filter(F.col("is_dir") | (F.col("size") >= min_size))


def with_md5(manifest: DataFrame) -> DataFrame:
    """Hash the content column map-side and drop it (PF1, PF2)."""
    return manifest.withColumn("md5", F.md5("content")).drop("content")


def _root_parts(root: str) -> int:
    """``substring_index`` count giving the root itself ('/drive' -> 2).  For
    the root '/' the first folder below it ('/a', count 2) is the start; '/'
    itself is added separately."""
    r = P.norm_root(root)
    return len(r.split("/")) if r else 2


def ancestor_rows(df: DataFrame, root: str, path_col: str = "path", include_self: bool = False,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ancestor folder (at or below ``root``) of each path:
    columns ``anc`` and ``up`` (how many levels above the path), plus
    ``keep``.  Built from ``sequence`` + ``substring_index`` -- compiled
    expressions, no higher-order functions -- so exploding billions of paths
    stays in generated code."""
    r = P.norm_root(root)
    k0 = _root_parts(root)
    p = F.col(path_col)
    n = P.depth_of(p)
    last = n if include_self else n - 1
    inside = (p == (r or "/")) if include_self else F.lit(False)
    inside = inside | P.under_root(p, root)
    ks = F.when(inside & (last >= k0), F.sequence(F.lit(k0), last)).otherwise(F.array().cast("array<int>"))
    out = df.select(*keep, p.alias("_p"), n.alias("_n"), F.explode(ks).alias("_k"))
    # the SQL form takes the count as an expression; the Python helper wants an int
    out = out.select(*keep, F.expr("substring_index(_p, '/', _k)").alias("anc"),
                     (F.col("_n") - F.col("_k")).alias("up"))
    if not r:  # root '/' is an ancestor of everything below it
        out = out.unionByName(df.filter(P.under_root(p, root)).select(*keep, F.lit("/").alias("anc"),
                                                                     (n - 1).alias("up")))
    return out


def folders_above(paths: DataFrame, root: str) -> DataFrame:
    """``path``: distinct folders at or below root that hold one of ``paths``
    at any depth.  Each folder's own chain is exploded once, not every file's:
    the distinct parents are far fewer rows."""
    r = P.norm_root(root) or "/"
    below = paths.select("path").filter(P.under_root("path", root))
    parents = below.select(P.parent_of("path").alias("path")).distinct()
    up = ancestor_rows(parents, root, include_self=True).select(F.col("anc").alias("path"))
    return (up if r != "/" else up.unionByName(parents.where("path = '/'"))).distinct()


def directories_of(manifest: DataFrame, root: str, extra: DataFrame | None = None) -> DataFrame:
    """Folder rows implied by the file paths (distinct ancestors at or below
    root), plus optional explicit folder rows (``path``)."""
    dirs = folders_above(manifest, root)
    if extra is not None:
        dirs = dirs.unionByName(extra.select("path")).distinct()
    return dirs.withColumn("is_dir", F.lit(True))


# --- stored manifests with folder partitions ---------------------------------------

PART_ROOT, PART_TOP = "manifest_root", "top_dir"


def write_manifest(manifest: DataFrame, location: str, root: str, mode: str = "overwrite") -> None:
    """Store a manifest partitioned by (``manifest_root``, ``top_dir``): the
    root it was taken under and each row's first-level folder, stored as
    '_' + name ('_' for files in the root) so that no value is empty (read
    back as NULL) or numeric-looking (read back as a number).  Verbs add predicates on these two columns that their own
    filters imply (skip lists, "below this folder"), so Catalyst prunes whole
    partitions before any file is opened.  Rows are sorted by folder inside
    each task instead of shuffled, so a huge first-level folder does not
    become one task."""
    r = P.norm_root(root) or "/"
    out = (manifest.withColumn(PART_ROOT, F.lit(r))
                   .withColumn(PART_TOP, F.concat(F.lit("_"), F.coalesce(P.top_of("path", root), F.lit(""))))
                   .sortWithinPartitions(PART_TOP))
    out.write.mode(mode).partitionBy(PART_ROOT, PART_TOP).parquet(location)


def _has_parts(df: DataFrame) -> bool:
    return PART_ROOT in df.columns and PART_TOP in df.columns


def prune_root(df: DataFrame, root: str):
    """Partition predicate implied by 'path is below ``root``': if the stored
    root is an ancestor of ``root``, only one first-level folder can hold
    such paths."""
    if not _has_parts(df):
        return F.lit(True)
    r = P.norm_root(root)
    parts = [x for x in r.split("/") if x]
    cond = None
    ancestors = []
    for i in range(len(parts)):
        anc = "/" + "/".join(parts[:i]) if i else "/"
        ancestors.append(anc)
        term = (F.col(PART_ROOT) == anc) & (F.col(PART_TOP) == "_" + parts[i])
        cond = term if cond is None else cond | term
    other = ~F.col(PART_ROOT).isin(ancestors) if ancestors else F.lit(True)
    return other if cond is None else (cond | other)


def prune_skipped(df: DataFrame, root: str, names) -> "F.Column":
    """Partition predicate implied by a skip list of exact folder names: the
    first-level folder of a stored manifest taken under the same root is not
    one of them."""
    if not _has_parts(df) or not names:
        return F.lit(True)
    r = P.norm_root(root) or "/"
    return (F.col(PART_ROOT) != r) | ~F.col(PART_TOP).isin(["_" + n for n in names])


def ensure_md5(df: DataFrame) -> DataFrame:
    """``df`` with an ``md5`` column: kept when present, else taken from
    ``content`` (JVM md5, content dropped), else read from the files in
    chunks.  Verbs call it on the rows they compare, never on the whole
    manifest."""
    if "md5" in df.columns:
        return df
    if "content" in df.columns:
        return with_md5(df)
    from filelake.sources.files import hash_paths
    return hash_paths(df)
