"""Clean-up of copy-marked names (V7: FL11, PF12, PF13, JN4, WN4, WN5, AG10).

The tool this reproduces works through copy files one by one in descending
(folder, stem) string order and judges each against whatever is at its clean
name at that moment.  Set-based equivalent, per clean path:

* an existing file at the clean path is the baseline for every contender;
* otherwise the first contender (greatest stem, then path) takes the clean
  name (``rename``) and is the baseline for the rest;
* same md5 as the baseline -> ``delete_duplicate``; different ->
  ``collision_rename`` to the next free ``stem_k`` name (in processing order);
  either md5 unknown -> ``skip``;
* a name whose clean form is itself (``archive (1).tar.gz``) -> ``skip``.

"First contender" is a max-aggregate, not a window, so a hot clean path is
combined map-side; only collision renamers are ranked (split when hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.functions.fmt import size_text_2
from filelake.operators import filters as FL
from filelake.operators.collide import assign_slots
from filelake.session import join_side, materialize_counted, small_side
from filelake.sources.manifest import ensure_md5


def copy_pattern(name) -> "F.Column":
    """PF12: '(N)' when ' (N).' occurs; else '- Copie' / '- Copy' for
    ' - Copy.' / ' - Copie (N).' (Copie if the name contains 'Copie')."""
    # a plain search first: most names of a lake hold neither text
    return (F.when(name.contains(" (") & name.rlike(C.COPY_NUMBER_REGEX), "(N)")
             .when(name.contains(" - Cop") & name.rlike(C.COPY_SUFFIX_REGEX),
                   F.when(name.contains("Copie"), "- Copie").otherwise("- Copy")))


def clean_name(name, pattern) -> "F.Column":
    """PF13.  (N): drop ' (N)' (N of the first match) only where it ends the
    stem; Copy: replace every match by '.'."""
    n = F.regexp_extract(name, C.COPY_NUMBER_REGEX, 1)
    stem, suffix = P.stem_of(name), P.raw_suffix(name)
    tail = F.concat(F.lit(" ("), n, F.lit(")"))
    clean_stem = F.when(stem.endswith(tail),
                        stem.substr(F.lit(1), F.length(stem) - F.length(tail))).otherwise(stem)
    return (F.when(pattern == "(N)", F.concat(clean_stem, suffix))
             .otherwise(F.regexp_replace(name, C.COPY_SUFFIX_REGEX, ".")))


def rename_candidates(manifest: DataFrame, root: str, protected=C.RENAME_PROTECTED) -> DataFrame:
    """Copy-marked files outside protected folders, with their clean path."""
    df = P.derive(manifest, root)
    if "is_dir" in df.columns:
        df = df.filter(~F.coalesce(F.col("is_dir"), F.lit(False)))
    df = df.filter(P.under_root("path", root) & FL.not_protected(F.col("rel_parent"), protected or ()))
    pat = copy_pattern(F.col("name"))
    df = df.withColumn("pattern", pat).filter(F.col("pattern").isNotNull())
    cn = clean_name(F.col("name"), F.col("pattern"))
    par = F.col("parent")
    return (df.withColumn("clean_name", cn)
              .withColumn("clean_path", F.when(par.endswith("/"), F.concat(par, cn))
                          .otherwise(F.concat(par, F.lit("/"), cn)))
              .withColumn("stem", P.stem_of(F.col("name"))))


def rename_plan(manifest: DataFrame, root: str, protected=C.RENAME_PROTECTED) -> DataFrame:
    """Plan rows: path, size, md5, pattern, clean_path, action
    (rename / delete_duplicate / collision_rename / skip), dest.

    Copy-marked files (a small share of a real manifest) are extracted once
    and written.  The manifest rows sitting at their clean paths (cut by a
    semi join, broadcast behind a row-count check) are the possible
    originals.  One aggregation keyed by clean path, over candidates and
    those rows, yields per clean path whether an original
    exists, its md5 and the first contender -- partial-aggregated, so a hot
    clean path is combined map-side -- and one join brings it back to the
    candidates.  The judged rows are written once more, because collision
    numbering and the final union both read them."""
    cands = rename_candidates(manifest, root, protected)
    c, seen = materialize_counted(ensure_md5(cands.select("path", "parent", "size", "pattern", "clean_name", "clean_path", "stem",
                                            *[x for x in ("md5", "content") if x in cands.columns])),
                    "rename-candidates")
    is_self = F.col("clean_path") == F.col("path")
    contender = F.when(~is_self, F.struct("stem", "path", "md5"))
    # only manifest rows sitting at some clean path can be originals: when the
    # clean paths are few (checked count) the manifest is cut map-side
    clean = small_side(c.select(F.col("clean_path").alias("path")).distinct(), "rename-clean-paths",
                       store=False, at_most=seen["rows"])  # ``c`` is stored: recomputing the distinct is cheap
    originals = ensure_md5(manifest.select("path", *[x for x in ("md5", "content") if x in manifest.columns])
                           .join(clean, "path", "left_semi"))
    per_key = (c.select(F.col("clean_path").alias("_key"), F.lit(1).alias("_copy"), contender.alias("_c"),
                        F.lit(0).alias("_orig"), F.lit(None).cast("string").alias("_orig_md5"))
               .unionByName(originals.select(F.col("path").alias("_key"), F.lit(0).alias("_copy"),
                                            F.lit(None).cast("struct<stem:string,path:string,md5:string>").alias("_c"),
                                            F.lit(1).alias("_orig"), F.col("md5").alias("_orig_md5")))
               .groupBy("_key")
               .agg(F.sum("_copy").alias("_n"), F.max("_orig").alias("_has_orig"),
                    F.max("_orig_md5").alias("orig_md5"), F.max("_c").alias("_first"))
               .filter(F.col("_n") > 0))
    # one clean path may have any share of the copies: its row goes to them, split or by broadcast
    j = join_side(c, per_key.withColumnRenamed("_key", "clean_path"), ["clean_path"], tag="rename-keys")
    has_orig = F.col("_has_orig") == 1
    is_first = F.col("path") == F.col("_first.path")
    base_md5 = F.when(has_orig, F.col("orig_md5")).otherwise(F.col("_first.md5"))
    judged = (F.when(F.col("md5").isNull() | base_md5.isNull(), "skip")
               .when(F.col("md5") == base_md5, "delete_duplicate")
               .otherwise("collision_rename"))
    action = (F.when(is_self, "skip")
               .when(~has_orig & is_first, "rename").otherwise(judged))
    j, seen = materialize_counted(j.withColumn("action", action)
                                  .select("path", "parent", "size", "md5", "pattern", "clean_name", "clean_path", "stem",
                                          "action"), "rename", movers=F.count_if(F.col("action") == "collision_rename"))

    keep = ["path", "size", "md5", "pattern", "clean_path", "action"]
    movers = j.filter(F.col("action") == "collision_rename")
    # names occupied in the clean folders: current files and the rename targets
    existing = (P.derive(manifest, root).select(F.col("parent").alias("dir"), "name")
                .unionByName(j.filter(F.col("action") == "rename")
                              .select(F.col("parent").alias("dir"), F.col("clean_name").alias("name"))))
    collided = assign_slots(movers, "parent", "clean_name", existing,
                            order=[F.col("stem").desc(), F.col("path").desc()], n_movers=seen["movers"])
    return (collided.select(*keep, "dest")
            .unionByName(j.filter(F.col("action") != "collision_rename")
                          .select(*keep, F.when(F.col("action") == "rename", F.col("clean_path")).alias("dest"))))


def rename_summary(plan: DataFrame) -> DataFrame:
    """AG10 (``total_scanned`` counts pattern files, as the original does)."""
    a = F.col("action")
    return plan.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count(F.lit(1)).alias("pattern_files_found"),
        F.count_if(a == "rename").alias("renamed"),
        F.count_if(a == "delete_duplicate").alias("duplicates_deleted"),
        F.count_if(a == "collision_rename").alias("collision_renamed"),
        F.count_if(a == "skip").alias("skipped"),
        F.coalesce(F.sum(F.when(a == "delete_duplicate", F.col("size"))), F.lit(0)).cast("bigint")
         .alias("space_freed"),
    ).withColumn("space_freed_human", size_text_2(F.col("space_freed")))
