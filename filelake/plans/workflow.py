"""Full reorganisation (V12): clean -> dedup -> sort -> snapshot -> diff.

Each step is planned on what the steps before it leave, and the plans are
composed into one (``plans.compose``), which is applied to the manifest once:
the manifest's rows, with content if it has any, meet a plan one time.  What the
later steps plan on is narrow: junk removal is a row filter, a new mode an
expression of the row, and the rows left after dedup are written once with the
columns that sorting reads.

Clean is the whole verb: junk, empty folders, permissions.  Stored steps go to
the session's reliable checkpoint folder (``spark.checkpoint.dir``): a lost
executor costs one step, not the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.operators import clean as CLN
from filelake.operators import dedup as D
from filelake.operators import snapshot as S
from filelake.operators import sort as SO
from filelake.plans.apply import apply_plan
from filelake.plans.compose import compose_in_place, effects
from filelake.session import materialize
from filelake.sources.manifest import with_md5


@dataclass
class Reorganisation:
    clean: DataFrame
    dedup: DataFrame
    sort: DataFrame
    plan: DataFrame
    before: S.Snapshot
    after: S.Snapshot
    final_manifest: DataFrame

    def summary(self) -> DataFrame:
        """One row of counts, all but the snapshots' from one pass over the
        composed plan (a row removed or moved also carries its new mode, which
        the permission count includes)."""
        diff = S.snapshot_diff(self.after, self.before, with_map=False)
        a, why = F.col("action"), F.col("reason")
        done = self.plan.agg(F.struct(
            F.count_if((a == "delete") & (why == JUNK)).alias("junk_deleted"), F.count_if(a == "rmdir").alias("dirs_removed"),
            F.count_if((a == "delete") & (why == DUPLICATE)).alias("duplicates_deleted"),
            F.count_if(a == "move").alias("files_sorted"), F.count("fixed").alias("permissions_fixed")).alias("s")).scalar()
        return diff.select(
            *[done[c].alias(c) for c in ("junk_deleted", "dirs_removed", "permissions_fixed", "duplicates_deleted", "files_sorted")],
            self.before.summary.select("total_files").scalar().alias("files_before"),
            self.after.summary.select("total_files").scalar().alias("files_after"),
            "size_change_bytes", "summary")


JUNK, DUPLICATE, SORTED = "junk", "duplicate", "sorted"


def _cut(df: DataFrame) -> DataFrame:
    return materialize(df, "reorganize")


def reorganize(manifest: DataFrame, root: str, dedup_min_size: int = C.DEDUP_MIN_SIZE,
               strategy: str = "deepest", sort_type: str = "auto", dirs: DataFrame | None = None,
               checkpoint: bool = True) -> Reorganisation:
    """``plan``: the composed plan, with ``fixed``, the mode that the clean step
    set on a row, whatever became of it."""
    cut = _cut if checkpoint else (lambda d: d)
    if "content" in manifest.columns and "md5" not in manifest.columns:
        manifest = cut(with_md5(manifest))  # hashed once: content goes no further
    clean = cut(CLN.clean_plan(manifest, root, dirs=dirs))
    # the file part of that plan on each row itself: no join, nothing to cut
    m1 = CLN.with_permissions(CLN.without_junk(manifest, root), root)
    dplan = D.dedup_plan(m1, root, min_size=dedup_min_size, strategy=strategy)
    gone = cut(effects(dplan, DUPLICATE))
    m2 = cut(apply_plan(m1.drop("content"), gone))
    splan = SO.sort_plan(m2, root, sort_type)
    steps = effects(clean.withColumn("reason", F.when(F.col("action") == "delete", JUNK)))
    fixed = clean.where("action = 'chmod'").select("path", F.col("new_mode").alias("fixed"))
    plan = cut(compose_in_place(steps, gone, effects(splan, SORTED)).join(fixed, "path", "left"))
    m3 = cut(apply_plan(manifest, plan))
    return Reorganisation(clean, dplan, splan, plan, S.snapshot(manifest, root, dirs=dirs), S.snapshot(m3, root), m3)
