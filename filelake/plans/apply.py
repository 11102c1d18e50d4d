"""Apply and verify plans (V9: JN8, JN9).

``apply_plan`` is the lazy post-operation manifest: one left join on the
(unique) path, deletes dropped, moves re-pathed.  ``verify_plan`` checks a
plan against a newer inventory before anything is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.session import join_side

DELETE_ACTIONS = ("delete", "delete_duplicate", "rmdir")
MOVE_ACTIONS = ("move", "rename", "collision_rename")


#: What a plan row may set, and the manifest column it sets.
ATTRIBUTES = {"new_mode": "mode", "new_uid": "uid", "new_gid": "gid"}


def apply_plan(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Manifest after the plan: delete-like rows (delete, delete_duplicate,
    rmdir) removed, move-like rows (move, rename, collision_rename) take
    ``dest`` as their path, and chmod and move-like rows take the ``new_mode``,
    ``new_uid`` and ``new_gid`` that are not null; everything else unchanged.
    An attribute the manifest has no column for is not applied.  One left join
    on the (unique) path."""
    sets = {new: old for new, old in ATTRIBUTES.items() if new in plan.columns and old in manifest.columns}
    acts = list(DELETE_ACTIONS + MOVE_ACTIONS) + ["chmod"]
    p = plan.filter(F.col("action").isin(acts)).select(
        "path", F.col("action").alias("_action"),
        (F.col("dest") if "dest" in plan.columns else F.lit(None).cast("string")).alias("_dest"),
        *[F.col(new).alias(f"_{new}") for new in sets])
    j = manifest.join(p, "path", "left").filter(~F.coalesce(F.col("_action").isin(list(DELETE_ACTIONS)), F.lit(False)))
    return _after(j, manifest, sets)


def _moved():
    return F.coalesce(F.col("_action").isin(list(MOVE_ACTIONS)), F.lit(False))


def _after(joined: DataFrame, manifest: DataFrame, sets: dict[str, str]) -> DataFrame:
    """The columns of ``manifest`` once each row's plan row is carried out."""
    out = joined.withColumn("path", F.when(_moved(), F.col("_dest")).otherwise(F.col("path")))
    for column, derived in (("parent", P.parent_of("path")), ("name", P.name_of("path")), ("ext", P.ext_of(P.name_of("path")))):
        if column in manifest.columns:
            out = out.withColumn(column, F.when(_moved(), derived).otherwise(F.col(column)))
    for new, old in sets.items():
        out = out.withColumn(old, F.coalesce(F.col(f"_{new}").cast(manifest.schema[old].dataType), F.col(old)))
    return out.select(*manifest.columns)


def verify_plan(plan: DataFrame, current: DataFrame) -> DataFrame:
    """JN8: status per plan row against a newer manifest.

    * keeper missing / keeper size changed -> 'keeper_missing' /
      'keeper_changed' (the whole group is skipped);
    * the file itself gone -> 'already_gone' (counts as done);
    * its size changed -> 'size_changed' (fails);
    * a move or rename whose destination now exists -> 'dest_exists';
    * otherwise 'ok'.

    Rows without a size (folders, permissions) are not compared by size.

    One keeper may own any share of the plan, so the distinct keepers are looked
    up once and joined back by ``session.join_side``.
    """
    given = plan.columns
    if "size" not in given:
        plan = plan.withColumn("size", F.lit(None).cast("bigint"))
    cur = current.select("path", F.col("size").alias("_cur_size"), F.lit(True).alias("_here"))
    j = plan.join(cur, "path", "left")
    has_keeper = "keeper_path" in plan.columns
    if has_keeper:
        kc = current.select(F.col("path").alias("keeper_path"), F.col("size").alias("_keeper_size"), F.lit(True).alias("_keeper_here"))
        kept = plan.where("keeper_path is not null").select("keeper_path").distinct().join(kc, "keeper_path")
        j = join_side(j, kept, ["keeper_path"], "left", "keepers")
        keeper_missing = F.col("keeper_path").isNotNull() & F.col("_keeper_here").isNull()
        keeper_changed = F.col("keeper_path").isNotNull() & (F.col("_keeper_size") != F.col("size"))
    else:
        keeper_missing = keeper_changed = F.lit(False)
    if "dest" in plan.columns:
        taken = current.select(F.col("path").alias("dest"), F.lit(True).alias("_dest_taken"))
        j = j.join(taken, "dest", "left")
        dest_exists = F.col("action").isin(list(MOVE_ACTIONS)) & F.coalesce(F.col("_dest_taken"), F.lit(False))
    else:
        dest_exists = F.lit(False)
    status = (F.when(keeper_missing, "keeper_missing")
               .when(keeper_changed, "keeper_changed")
               .when(F.col("_here").isNull(), "already_gone")
               .when(F.col("_cur_size") != F.col("size"), "size_changed")
               .when(dest_exists, "dest_exists")
               .otherwise("ok"))
    return j.withColumn("status", status).select(*given, "status")
