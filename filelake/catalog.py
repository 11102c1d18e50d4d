"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the fixture manifest derived
from ``documents``, or ``events`` for the operation log) so its work grows
with the data.  Output columns are aliased to the names the SQL oracle uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import fmt as FM
from filelake.functions import paths as P
from filelake.operators import classify as CL
from filelake.operators import clean as CLN
from filelake.operators import consolidate as CO
from filelake.operators import dedup as D
from filelake.operators import rename as RN
from filelake.operators import snapshot as S
from filelake.operators import sort as SO
from filelake.plans import apply as AP
from filelake.plans import batches as BA
from filelake.plans import compose as CM
from filelake.plans import oplog as OL
from filelake.plans import workflow as WF
from filelake.plans.commitlog import CommitLog
from filelake.session import ensure_checkpoint_dir
from filelake.sources import fixture as FX
from filelake.sources.manifest import from_table
from filelake.sources import snapshot_io as IO
from filelake.sources.snapshot_io import read_snapshot, snapshot_from_record, write_snapshot
from filelake.sources.store import ManifestStore

ROOT = FX.ROOT
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- dedup -------------------------------------------------------------------

@register("dedup_summary")
def q_dedup_summary(spark, sf_dir):
    return D.dedup_summary(FX.manifest(spark, sf_dir), ROOT, min_size=100)


def _plan_cols(plan: DataFrame) -> DataFrame:
    return plan.select("path", "size", "md5", "keeper_path", "action")


@register("dedup_plan_deepest")
def q_dedup_plan_deepest(spark, sf_dir):
    return _plan_cols(D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100, strategy="deepest"))


@register("dedup_plan_newest")
def q_dedup_plan_newest(spark, sf_dir):
    return _plan_cols(D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100, strategy="newest"))


@register("dedup_plan_largest")
def q_dedup_plan_largest(spark, sf_dir):
    return _plan_cols(D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100, strategy="largest"))


# --- snapshot ------------------------------------------------------------------


def _snap(spark, sf_dir, keep=None, gone=None):
    man = FX.manifest(spark, sf_dir, keep)
    if gone:
        man = man.filter(F.col("ext") != gone)
    return S.snapshot(man, ROOT, dirs=FX.directories(spark, man).select("path"))


@register("snapshot_by_extension")
def q_snapshot_by_extension(spark, sf_dir):
    return _snap(spark, sf_dir).by_extension


@register("snapshot_samples")
def q_snapshot_samples(spark, sf_dir):
    return _snap(spark, sf_dir).samples.select("ext", F.col("sample_rank").cast("bigint"), "path")


@register("snapshot_top_dirs")
def q_snapshot_top_dirs(spark, sf_dir):
    return _snap(spark, sf_dir).top_dirs


@register("snapshot_largest")
def q_snapshot_largest(spark, sf_dir):
    return _snap(spark, sf_dir).largest.select(F.col("rank").cast("bigint"), "path", "size_bytes")


@register("snapshot_quick")
def q_snapshot_quick(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    rec = S.snapshot(man, ROOT, quick=True, dirs=FX.directories(spark, man).select("path")).record()
    return rec.select("summary.total_files", "summary.total_size_bytes", F.size("by_extension").cast("bigint").alias("n_extensions"),
                      F.size("largest_files").cast("bigint").alias("n_largest"))


@register("snapshot_summary")
def q_snapshot_summary(spark, sf_dir):
    return _snap(spark, sf_dir).summary


def _pair(spark, sf_dir):
    # the pair of the difference: some files and one extension only before, some only after
    return (_snap(spark, sf_dir, F.col("doc_id") % 13 != 0, ".gz"),
            _snap(spark, sf_dir, F.col("doc_id") % 10 != 0, ".psd"))


@register("snapshot_diff")
def q_snapshot_diff(spark, sf_dir):
    cur, prev = _pair(spark, sf_dir)
    return S.snapshot_diff(cur, prev, with_map=False)


@register("snapshot_ext_changes")
def q_snapshot_ext_changes(spark, sf_dir):
    cur, prev = _pair(spark, sf_dir)
    return S.ext_changes(cur, prev)


@register("snapshot_diff_stored")
def q_snapshot_diff_stored(spark, sf_dir):
    """The previous snapshot is written as a document and read back."""
    cur, prev = _pair(spark, sf_dir)
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/filelake-snapshot-{uuid.uuid4().hex}"
    write_snapshot(prev.record(), place)
    d = S.snapshot_diff(cur, snapshot_from_record(read_snapshot(spark, place), ROOT))
    return d.withColumn("new_extension_counts", F.to_json("new_extension_counts"))


@register("snapshot_diff_sharded")
def q_snapshot_diff_sharded(spark, sf_dir):
    """The previous snapshot as a sharded folder, the difference as another."""
    cur, prev = _pair(spark, sf_dir)
    old, new = _place(spark, "snapshot"), _place(spark, "diff")
    IO.write_sharded(prev, old)
    prev = IO.read_sharded(spark, old)
    IO.write_sharded_diff(S.snapshot_diff(cur, prev, with_map=False), S.ext_changes(cur, prev), new)
    head, changes = IO.read_sharded_diff(spark, new)
    return changes.select("ext", "change", "count", head.select("summary").scalar().alias("summary"))


@register("snapshot_diff_document")
def q_snapshot_diff_document(spark, sf_dir):
    """The difference written as a document and read back as what it is."""
    cur, prev = _pair(spark, sf_dir)
    place = _place(spark, "diff")
    write_snapshot(IO.diff_record(S.snapshot_diff(cur, prev), ROOT), place)
    return read_snapshot(spark, place).select(
        "path", "is_diff", F.col("summary_text").alias("summary"), "files_added", "files_removed", "size_change_bytes",
        F.size("new_extensions").cast("bigint").alias("new_extensions"))


# --- sort -------------------------------------------------------------------------


@register("detect_type")
def q_detect_type(spark, sf_dir):
    d = CL.detect_type(CL.sort_files(FX.manifest(spark, sf_dir), ROOT))
    return d.select(*[F.col(t).cast("bigint") for t in CL.TYPES], F.col("total").cast("bigint"), "detected_type")


def _sorted(sort_type):
    def q(spark, sf_dir):
        return CL.classify(FX.manifest(spark, sf_dir), ROOT, sort_type).select("path", "category")
    return q


for _t in ("mixed", "documents", "music", "pictures", "videos"):
    register(f"sort_{_t}")(_sorted(_t))


@register("sort_auto_families")
def q_sort_auto_families(spark, sf_dir):
    """Files of one extension family at a time, sorted by the detected type."""
    man = FX.manifest(spark, sf_dir)
    families = {"documents": C.DOCUMENT_EXTS, "music": C.MUSIC_EXTS, "pictures": C.PICTURE_EXTS, "videos": C.VIDEO_EXTS}
    parts = [CL.classify(man.filter(F.col("ext").isin(list(exts))), ROOT, "auto").select(F.lit(t).alias("family"), "path", "category")
             for t, exts in families.items()]
    return reduce(DataFrame.unionByName, parts)


@register("sort_plan_collisions")
def q_sort_plan_collisions(spark, sf_dir):
    return SO.sort_plan(FX.manifest(spark, sf_dir), ROOT).select("path", "action", "dest")


@register("sort_summary")
def q_sort_summary(spark, sf_dir):
    s = SO.sort_summary(SO.sort_plan(FX.manifest(spark, sf_dir), ROOT))
    return s.select("total_files", "moved_count", "skipped_count", "space_organized",
                    F.col("categories").cast("bigint"))


@register("sort_by_category")
def q_sort_by_category(spark, sf_dir):
    return SO.by_category(SO.sort_plan(FX.manifest(spark, sf_dir), ROOT))


# --- rename -----------------------------------------------------------------------


@register("rename_patterns")
def q_rename_patterns(spark, sf_dir):
    return RN.rename_candidates(FX.manifest(spark, sf_dir), ROOT).select("path", "pattern", "clean_path")


@register("rename_actions")
def q_rename_actions(spark, sf_dir):
    return RN.rename_plan(FX.manifest(spark, sf_dir), ROOT).select("path", "clean_path", "action", "dest")


@register("rename_summary")
def q_rename_summary(spark, sf_dir):
    return RN.rename_summary(RN.rename_plan(FX.manifest(spark, sf_dir), ROOT))


# --- consolidate -------------------------------------------------------------------


TARGET = FX.TARGET


@register("consolidate_plan")
def q_consolidate_plan(spark, sf_dir):
    return CO.consolidate_plan(FX.manifest(spark, sf_dir), ROOT, TARGET).select("path", "size", "action", "dest")


@register("consolidate_summary")
def q_consolidate_summary(spark, sf_dir):
    return CO.consolidate_summary(FX.manifest(spark, sf_dir), ROOT, TARGET)


@register("consolidate_presets")
def q_consolidate_presets(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    parts = [CO.consolidate_plan(man, ROOT, TARGET, file_type=t).select(F.lit(t).alias("preset"), "path", "size", "action", "dest")
             for t in C.PRESETS]
    return reduce(DataFrame.unionByName, parts)


@register("consolidate_target_tree")
def q_consolidate_target_tree(spark, sf_dir):
    """The target is a tree of its own: an older inventory below /archive."""
    old = FX.previous_manifest(spark, sf_dir).withColumn("path", F.concat(F.lit("/archive"), "path"))
    return CO.consolidate_plan(FX.manifest(spark, sf_dir), ROOT, "/archive", target_manifest=old).select("path", "size", "action", "dest")


# --- clean ---------------------------------------------------------------------------


@register("junk_files")
def q_junk_files(spark, sf_dir):
    return CLN.junk_plan(FX.manifest(spark, sf_dir), ROOT).select("path", "size")


@register("empty_dirs")
def q_empty_dirs(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    return CLN.empty_dirs_plan(FX.directories(spark, man), man, ROOT).select(
        "path", F.col("height").cast("bigint"))


@register("permission_plan")
def q_permission_plan(spark, sf_dir):
    return CLN.permission_plan(FX.manifest(spark, sf_dir)).select(
        "path", F.col("mode").cast("bigint"), F.col("new_mode").cast("bigint"))


@register("clean_summary")
def q_clean_summary(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    plan = CLN.clean_plan(man, ROOT, dirs=FX.directories(spark, man))
    return CLN.clean_summary(plan)


# --- dedup facets ---------------------------------------------------------------------


@register("duplicate_size_groups")
def q_duplicate_size_groups(spark, sf_dir):
    cand = D.candidates(FX.manifest(spark, sf_dir), ROOT, min_size=100)
    return D.shared_sizes(cand)


@register("duplicate_hash_groups")
def q_duplicate_hash_groups(spark, sf_dir):
    cand = D.candidates(FX.manifest(spark, sf_dir), ROOT, min_size=100)
    return D.groups(D.hashed(cand)).select("md5", "size", "n_files", "keeper_path")


@register("keeper_score")
def q_keeper_score(spark, sf_dir):
    cand = D.candidates(FX.manifest(spark, sf_dir), ROOT, min_size=100)
    s = P.keeper_score("path", "name")
    return cand.select("path", *[s[f].cast("bigint").alias(f) for f in ("depth", "copy_rank", "uuid_rank", "parens_rank")])


@register("dedup_include_exclude")
def q_dedup_include_exclude(spark, sf_dir):
    plan = D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100,
                        include=["*.txt", "*.PDF", "*.jp?g", "*.jpg"], exclude=["* - Copy.*", "[!f]*(1).txt"])
    return plan.select("path", "keeper_path", "action")


@register("dedup_skip_dirs")
def q_dedup_skip_dirs(spark, sf_dir):
    plan = D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100, skip_dirs=["Library", "_from_*"])
    return plan.select("path", "keeper_path", "action")


# --- plans ------------------------------------------------------------------------------


@register("apply_plan_dedup")
def q_apply_plan_dedup(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    plan = D.dedup_plan(man, ROOT, min_size=100)
    return AP.apply_plan(man, plan).select("path", "size", "md5")


@register("apply_plan_sort")
def q_apply_plan_sort(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    return AP.apply_plan(man, SO.sort_plan(man, ROOT)).select("path", "size", "md5")


@register("verify_plan")
def q_verify_plan(spark, sf_dir):
    prev = FX.previous_manifest(spark, sf_dir)
    cur = FX.current_manifest(spark, sf_dir).withColumn(
        "size", F.when(F.col("mtime_s") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))  # grown since
    plan = D.dedup_plan(prev, ROOT, min_size=100)
    return AP.verify_plan(plan, cur).select("path", "action", "status")


@register("verify_plan_sort")
def q_verify_plan_sort(spark, sf_dir):
    """A sort planned earlier, when some files lie in the music folder by now."""
    plan = SO.sort_plan(FX.previous_manifest(spark, sf_dir), ROOT)
    cur = FX.current_manifest(spark, sf_dir)
    there = cur.filter(F.col("ext") == ".mp3").select(F.concat(F.lit("/drive/Music/"), "name").alias("path"), "size")
    cur = cur.select("path", "size").unionByName(there).groupBy("path").agg(F.max("size").alias("size"))
    return AP.verify_plan(plan, cur).select("path", "action", "status")


@register("oplog_recover")
def q_oplog_recover(spark, sf_dir):
    return OL.op_log_recover(FX.oplog_events(spark, sf_dir)).select(
        F.col("op_id").cast("bigint").alias("op_id"), "status")


@register("verify_plan_rename")
def q_verify_plan_rename(spark, sf_dir):
    """A rename planned earlier, when some originals lie at the clean names by now."""
    plan = RN.rename_plan(FX.previous_manifest(spark, sf_dir), ROOT)
    return AP.verify_plan(plan, FX.current_manifest(spark, sf_dir)).select("path", "action", "status")


def _owned(spark, sf_dir):
    """The manifest with owners: uid by time, no gid known."""
    return FX.manifest(spark, sf_dir).withColumns({"uid": (F.col("mtime_s") % 3).cast("int"), "gid": F.lit(None).cast("int")})


@register("apply_plan_clean")
def q_apply_plan_clean(spark, sf_dir):
    """Junk removed, modes and owners set."""
    man = _owned(spark, sf_dir)
    plan = CLN.clean_plan(man, ROOT, dirs=FX.directories(spark, man), uid=1, gid=8)
    return AP.apply_plan(man, plan).select("path", *[F.col(c).cast("bigint").alias(c) for c in ("mode", "uid", "gid")])


def _place(spark, tag):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/filelake-{tag}-{uuid.uuid4().hex}"


@register("stored_versions")
def q_stored_versions(spark, sf_dir):
    """Clean, then sort, as versions of a co-partitioned store."""
    v0 = ManifestStore.create(FX.manifest(spark, sf_dir), _place(spark, "store"))
    v1 = v0.advance(CLN.clean_plan(v0.plain(), ROOT))
    v2 = v1.advance(SO.sort_plan(v1.plain(), ROOT))
    for v in (v0, v1, v2):
        v.forget()
    return v2.plain().select("path", "size", "md5", F.col("mode").cast("bigint").alias("mode"))


@register("stored_verify")
def q_stored_verify(spark, sf_dir):
    """``verify_plan`` against a stored manifest: only plan rows move."""
    cur = FX.current_manifest(spark, sf_dir).withColumn(
        "size", F.when(F.col("mtime_s") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    store = ManifestStore.create(cur, _place(spark, "store"))
    plan = D.dedup_plan(FX.previous_manifest(spark, sf_dir), ROOT, min_size=100)
    return store.verify(plan).select("path", "action", "status")


@register("composed_plan")
def q_composed_plan(spark, sf_dir):
    """Clean, dedup and sort, each planned on what is left, as one plan."""
    man = FX.manifest(spark, sf_dir)
    plan = WF.reorganize(man, ROOT, dedup_min_size=100, dirs=FX.directories(spark, man).select("path")).plan
    return plan.select("path", "action", "dest", F.col("new_mode").cast("bigint").alias("new_mode"), "reason")


@register("oplog_replan_recover")
def q_oplog_replan_recover(spark, sf_dir):
    """The clean plan logged, some of it done or failed, folded into a
    checkpoint, the dedup plan logged after it; what is left to do, with all
    that a chmod needs."""
    man = FX.manifest(spark, sf_dir)
    log = CommitLog(spark, _place(spark, "oplog"))
    log.append(OL.op_log_from_plan(CLN.clean_plan(man, ROOT, dirs=FX.directories(spark, man)), run="clean"))
    todo, part = log.recover(), F.length("source") % 3
    log.append(OL.op_log_update(todo.where(part == 0), "done", 1))
    log.append(OL.op_log_update(todo.where(part == 1), "failed", 1))
    log.checkpoint()
    log.append(OL.op_log_update(log.recover().where((part == 1) & (F.col("op_type") == "delete")), "done", 2))
    log.append(OL.op_log_from_plan(D.dedup_plan(man, ROOT, min_size=100), run="dedup"))
    return log.recover().select("op_id", "op_type", "source", "hash", F.col("new_mode").cast("bigint").alias("new_mode"), "status")


@register("oplog_recover_stored")
def q_oplog_recover_stored(spark, sf_dir):
    """The dedup plan appended to a log, part of it done, read and recovered."""
    place = _place(spark, "oplog")
    OL.append_op_log(OL.op_log_from_plan(D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100)), place)
    done = OL.load_op_log(spark, place).where(F.col("expected_size") % 2 == 0)
    OL.append_op_log(OL.op_log_update(done, "done", 1), place)
    log = OL.load_op_log(spark, place)
    return OL.op_log_recover(log).join(log.where("seq = 0").select("op_id", "source", "hash", "expected_size"), "op_id")


@register("delete_batches")
def q_delete_batches(spark, sf_dir):
    plan = D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100)
    b = BA.delete_batches(plan, 50)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"),
                                     F.sum("size").cast("bigint").alias("bytes"),
                                     F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@register("reorganize_summary")
def q_reorganize_summary(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    r = WF.reorganize(man, ROOT, dedup_min_size=100, dirs=FX.directories(spark, man).select("path"))
    return r.summary()


# --- formats ------------------------------------------------------------------------------


@register("format_sizes")
def q_format_sizes(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    s = F.col("size").cast("decimal(38,0)")  # scaled sizes must not overflow BIGINT (ANSI mode)
    return man.select(
        "path",
        FM.size_text_signed(s).alias("f1"),
        FM.size_text_signed(-s * 1536).alias("f1_neg"),
        FM.size_text(s * 1024 * 7).alias("f2"),
        FM.size_text_2(s * 1048576).alias("f3"),
        FM.size_text_2(s * (1 << 40)).alias("f3_big"),
        FM.size_text(s * (1 << 44)).alias("f2_big"))


# --- per-file projections ---------------------------------------------------------------------

@register("picture_years")
def q_picture_years(spark, sf_dir):
    files = CL.sort_files(FX.manifest(spark, sf_dir), ROOT)
    imgs = files.filter(F.col("ext").isin(list(C.IMAGE_EXTS)))
    return imgs.select("path", CL.year_from_exif(F.col("exif_date")).cast("bigint").alias("exif_year"),
                       CL.year_from_name(F.col("name")).cast("bigint").alias("name_year"))


@register("staging_subdirs")
def q_staging_subdirs(spark, sf_dir):
    files = CO.scan(FX.manifest(spark, sf_dir), ROOT, TARGET)
    return files.select("path", "in_target", CO.staging_subdir(F.col("path"), ROOT).alias("subdir"))


@register("normalized_names")
def q_normalized_names(spark, sf_dir):
    names = FX.manifest(spark, sf_dir).select("name").distinct()
    return names.select("name", P.normalized_name(F.col("name")).alias("normalized"))


@register("oplog_from_plan")
def q_oplog_from_plan(spark, sf_dir):
    plan = D.dedup_plan(FX.manifest(spark, sf_dir), ROOT, min_size=100)
    return OL.op_log_from_plan(plan).select("op_id", "op_type", "source", "hash", "expected_size", "status")


@register("apply_plan_rename")
def q_apply_plan_rename(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    return AP.apply_plan(man, RN.rename_plan(man, ROOT)).select("path", "size", "md5")


@register("snapshot_record_shape")
def q_snapshot_record_shape(spark, sf_dir):
    rec = _snap(spark, sf_dir).record()
    return rec.select("path", F.col("summary.total_files").alias("total_files"),
                      F.col("summary.total_size_bytes").alias("total_size_bytes"),
                      F.size("by_extension").cast("bigint").alias("n_extensions"),
                      F.size("top_level_dirs").cast("bigint").alias("n_top_dirs"),
                      F.size("largest_files").cast("bigint").alias("n_largest"),
                      F.col("largest_files")[0]["path"].alias("largest_path"),
                      F.aggregate(F.map_values("by_extension"), F.lit(0).cast("bigint"),
                                  lambda acc, v: acc + F.size(v["sample_paths"])).alias("n_samples"))


@register("clean_plan_rows")
def q_clean_plan_rows(spark, sf_dir):
    man = FX.manifest(spark, sf_dir)
    return CLN.clean_plan(man, ROOT, dirs=FX.directories(spark, man)).select("path", "action")


@register("permission_plan_ntfs")
def q_permission_plan_ntfs(spark, sf_dir):
    return CLN.permission_plan_ntfs(FX.manifest(spark, sf_dir)).select(
        "path", F.col("mode").cast("bigint"), F.col("new_mode").cast("bigint"),
        F.col("new_uid").cast("bigint"), F.col("new_gid").cast("bigint"))


@register("sort_plan_target")
def q_sort_plan_target(spark, sf_dir):
    return SO.sort_plan(FX.manifest(spark, sf_dir), ROOT, target_root="/sorted").select("path", "action", "dest")


# --- from content: documents as files, hashed by the verbs themselves ------------------------


def _content(spark, sf_dir):
    docs = FX.load_table(spark, sf_dir, "documents")
    return from_table(docs, F.concat(F.lit("/docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")),
                      F.coalesce("text", F.lit("")), mtime_s=F.col("doc_id").cast("bigint"))


@register("dedup_from_content")
def q_dedup_from_content(spark, sf_dir):
    return _plan_cols(D.dedup_plan(_content(spark, sf_dir), "/docs", min_size=1, strategy="newest"))


@register("consolidate_from_content")
def q_consolidate_from_content(spark, sf_dir):
    m = _content(spark, sf_dir).withColumn("path", F.when(F.col("mtime_s") % 3 == 0, F.concat(F.lit("/docs/kept"), F.col("path").substr(6, 1 << 30)))
                                           .otherwise(F.col("path")))
    return CO.consolidate_summary(m, "/docs", "/docs/kept", min_size=1)
