"""The fixture manifest: a file inventory derived from the ``documents``
table, so that every verb runs on real, growing input and can be checked
against an independent SQL engine.  Layout: fifteen folders under ``/drive``,
every document one file with its whole text, names with copy markers, copies
of some files, some unreadable (NULL md5), zero-byte and symlinked rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import materialize

ROOT = "/drive"
TARGET = "/drive/Library"

# Parent folder per doc_id % 8, and the one used instead when g % 7 = 3.
_PARENTS = ["/drive/Documents/{lang}", "/drive/Desktop", "/drive/SOFITEL/2024", "/drive/_from_movies",
            "/drive/Library/Archive", "/drive/node_modules/pkg", "/drive/Library/_STAGING/old",
            "/drive/Inbox/data"]
_OTHER_PARENTS = ["/drive/Documents/{lang}", "/drive", "/drive/OneDrive", "/drive/_from_2019", "/drive/Music",
                  "/drive/src/.git/objects", "/drive/_from_whatsapp video", "/drive/_from_pellicule"]


def _case(key: Column, mapping: dict, default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr.otherwise(default)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_manifest(documents: DataFrame, keep: Column | None = None) -> DataFrame:
    """Manifest rows (path, parent, name, size, ext, md5, mtime_s, is_symlink,
    artist, exif_date, mode).  ``keep`` filters documents first (used for the
    snapshot pair).  Every document is a file holding its whole text (null:
    empty); the first of an even group also lies there twice as a marked copy,
    and some documents have a zero-byte file beside them."""
    docs = documents if keep is None else documents.filter(keep)
    d = F.col("doc_id") % 8
    k = F.floor(F.col("doc_id") / 8).cast("bigint")
    base = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), d.alias("d"), k.alias("k"))
    grp = base.select("*", F.floor(F.col("k") / 3).cast("bigint").alias("g"), (F.col("k") % 3).alias("v"))
    g, v, e = F.col("g"), F.col("v"), F.col("e")
    none = F.array().cast("array<int>")
    # e: 0 the file, 1 and 2 its copies, 3 the zero-byte file
    grp = grp.withColumn("e", F.explode(F.concat(
        F.array(F.lit(0)), F.when((v == 0) & (g % 2 == 0), F.array(F.lit(1), F.lit(2))).otherwise(none),
        F.when(F.col("k") % 29 == 0, F.array(F.lit(3))).otherwise(none))))
    g6, g23 = g % 6, g % 23

    def folder(names):
        return _case(F.col("d"), {i: F.concat(F.lit("/drive/Documents/"), F.col("lang")) if i == 0 else F.lit(n)
                                  for i, n in enumerate(names[:7])}, F.lit(names[7]))

    parent = F.when(g % 7 == 3, folder(_OTHER_PARENTS)).otherwise(folder(_PARENTS))
    gs = g.cast("string")
    h = F.md5(gs)
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    plain = _case(g6, {2: F.concat(F.lit("IMG_"), (F.lit(1985) + g % 50).cast("string"), F.lit("0115_"), gs),
                       4: F.concat(F.lit("N_20240115_"), F.lpad(gs, 6, "0"))},
                  F.concat(F.lit("f"), gs))
    stem = _case(g23, {3: F.concat(F.lit("Été déjà "), gs), 5: uuid, 7: F.concat(F.lit(".hidden"), gs),
                       13: F.concat(F.lit("~$f"), gs)}, plain)
    # no file lies at the clean path of these groups' copies
    stem = F.when((e == 0) & (v == 0) & (g % 5 == 0), F.concat(F.lit("only_"), stem)).otherwise(stem)
    marker = _case(e, {1: F.lit(" (2)"), 2: F.lit(" - Copie")}, _case(v, {0: F.lit(""), 1: F.lit(" (1)")}, F.lit(" - Copy")))
    ext0 = _case(g23, {9: F.lit(".tar.gz"), 11: F.lit(".psd"), 15: F.lit(".eml")},
                 _case(g6, {0: F.lit(".txt"), 1: F.lit(".PDF"), 2: F.lit(".jpg"), 3: F.lit(".mp3"),
                            4: F.lit(".mp4")}, F.lit(".tmp")))
    name = F.when(e == 3, F.concat(F.lit("blank_"), F.col("k").cast("string"), F.lit(".txt"))).otherwise(F.concat(stem, marker, ext0))
    content = F.when(e == 3, F.lit("")).otherwise(F.col("text"))
    named = grp.select("doc_id", "e", parent.alias("parent"), name.alias("name"), content.alias("content"))
    doc = F.col("doc_id")
    return named.select(
        F.concat("parent", F.lit("/"), "name").alias("path"),
        "parent", "name",
        F.octet_length("content").cast("bigint").alias("size"),
        F.lower(F.regexp_extract("name", r"^.+([.][^.]+)$", 1)).alias("ext"),
        F.when(doc % 97 == 0, F.lit(None).cast("string")).otherwise(F.md5("content")).alias("md5"),
        (F.lit(1704067200) + (doc * 7919) % 2592000 + F.col("e")).cast("bigint").alias("mtime_s"),
        (doc % 53 == 0).alias("is_symlink"),
        F.when(doc % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Artist/"), (doc % 5).cast("string"))).alias("artist"),
        F.when(doc % 4 == 0, F.concat((F.lit(2000) + doc % 25).cast("string"), F.lit(":01:15 00:00:00")))
         .alias("exif_date"),
        _case(doc % 4, {0: F.lit(420), 1: F.lit(384), 2: F.lit(493)}, F.lit(448)).cast("int").alias("mode"),
    )


_STORED: dict[tuple, str] = {}


def manifest(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """The fixture manifest, materialised like a stored inventory table.

    The derivation is one long expression chain; left inline, the optimizer
    copies it into every downstream expression and pushed-down filter (the
    generated code outgrows the JVM method limit).  Writing it once to the
    session's checkpoint folder cuts that lineage: queries then read a stored
    inventory table, as they would in production.  Within one application
    the stored table is written once per (folder, filter) and then read."""
    import os
    key = (spark.sparkContext.applicationId, os.path.realpath(sf_dir), None if keep is None else str(keep))
    location = _STORED.get(key)
    if location is not None:
        try:
            return spark.read.parquet(location)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            _STORED.pop(key, None)  # the folder is gone: derived again
    df = materialize(fixture_manifest(load_table(spark, sf_dir, "documents"), keep), "manifest")
    _STORED[key] = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else None
    return df


def previous_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older inventory of the snapshot pair."""
    return manifest(spark, sf_dir, F.col("doc_id") % 10 != 0)


def current_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer inventory of the snapshot pair."""
    return manifest(spark, sf_dir, F.col("doc_id") % 13 != 0)


# Folder chains with no files: two removable chains and one guarded by a
# protected folder.
EXTRA_DIRS = ["/drive/empty", "/drive/e1", "/drive/e1/e2", "/drive/e1/e2/e3", "/drive/e4", "/drive/e4/.git"]


def directories(spark: SparkSession, man: DataFrame) -> DataFrame:
    """Folder rows: every ancestor of a manifest path plus the empty chains."""
    from filelake.sources.manifest import directories_of
    extra = spark.createDataFrame([(p,) for p in EXTRA_DIRS], "path string")
    return directories_of(man, ROOT, extra)


def oplog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation log whose rows are status updates: op_id, seq, status."""
    ev = load_table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "purchase", "done")
               .when(F.col("event_type") == "error", "failed").otherwise("pending"))
    return ev.select(F.col("user_id").alias("op_id"), F.col("event_id").alias("seq"),
                     status.alias("status"), F.col("ts"))


def replicated_manifest(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """The fixture manifest ``copies`` times over, each copy under its own
    first-level folder (``/drive/rep<i>/...``).  Content hashes repeat, so
    every duplicate group grows ``copies``-fold: a scaling and skew input for
    the bench, derived by Spark from the given tables."""
    base = manifest(spark, sf_dir)
    rep = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_rep")
    out = base.select(rep, *base.columns)
    new_path = F.concat(F.lit(ROOT + "/rep"), F.col("_rep").cast("string"), F.col("path").substr(len(ROOT) + 1, 1 << 30))
    out = (out.withColumn("path", new_path)
              .withColumn("parent", F.concat(F.lit(ROOT + "/rep"), F.col("_rep").cast("string"),
                                             F.col("parent").substr(len(ROOT) + 1, 1 << 30)))
              .drop("_rep"))
    # one input file would make every later scan a single task: spread it
    parts = max(spark.sparkContext.defaultParallelism * 2, copies // 4)
    return materialize(out.repartition(parts, "path"), f"manifest-x{copies}")
