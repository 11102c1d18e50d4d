"""Sort verb (V4): move files into category folders with collision-free
names (CL6, JN7, WN5, AG9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.operators.classify import classify
from filelake.operators.collide import assign_slots
from filelake.session import materialize_counted


def sort_plan(manifest: DataFrame, root: str, sort_type: str = "auto",
              target_root: str | None = None) -> DataFrame:
    """Plan rows: path, size, category, action ('move' / 'skip'), dest.
    A file already in its category folder is skipped (not renamed to _1)."""
    target = P.norm_root(target_root or root)
    files = classify(manifest, root, sort_type)
    # classified once, read by the skip branch, the movers and the slot count
    at_dest = F.col("parent") == F.col("dest_dir")
    files, seen = materialize_counted(files.select("path", "size", "name", "parent", "category",
                                                   F.concat(F.lit(target + "/"), F.col("category")).alias("dest_dir")), "sort",
                                      movers=F.count_if(~at_dest))
    skips = files.filter(at_dest).select("path", "size", "category", F.lit("skip").alias("action"),
                                         F.col("path").alias("dest"))
    movers = files.filter(~at_dest)
    existing = (manifest.filter(P.under_root("path", target))
                        .select(P.parent_of("path").alias("dir"), P.name_of("path").alias("name")))
    moved = assign_slots(movers, "dest_dir", "name", existing, n_movers=seen["movers"])
    moves = moved.select("path", "size", "category", F.lit("move").alias("action"), "dest")
    return moves.unionByName(skips)


def by_category(plan: DataFrame) -> DataFrame:
    """AG9 per category: category, files, bytes.  Kept as rows: with the
    music rules categories are artists, so their number grows with the data."""
    return plan.groupBy("category").agg(F.count(F.lit(1)).alias("files"),
                                        F.sum("size").cast("bigint").alias("bytes"))


def sort_summary(plan: DataFrame) -> DataFrame:
    """AG9: total_files, moved_count, skipped_count, space_organized and the
    number of categories (per-category counts: ``by_category``)."""
    return plan.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("action") == "move").alias("moved_count"),
        F.count_if(F.col("action") == "skip").alias("skipped_count"),
        F.coalesce(F.sum(F.when(F.col("action") == "move", F.col("size"))), F.lit(0)).cast("bigint")
         .alias("space_organized"),
        F.count_distinct("category").alias("categories"),
    )
