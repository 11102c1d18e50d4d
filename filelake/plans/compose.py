"""Plan algebra (V9, V12): several plans, each made for the manifest the one
before leaves, as one plan that is applied once.

A plan row says what becomes of one path: removed, at ``dest``, or in place,
with new attributes.  ``compose(first, second)`` is one full outer join of the
place where ``first`` leaves a row with the path by which ``second`` names it:

* what ``first`` removes stays removed, for the reason of ``first``;
* a move, then a delete, is a delete of the place the row had at the start; a
  move, then a move, goes to the last destination; a row that comes back to
  where it was is not moved;
* attributes that ``second`` sets win over those of ``first``; the rest carry on;
* rows of ``second`` whose path ``first`` left alone are taken as they are.

Both sides are shuffled by that place, plan rows only, and a plan has one row
per path, so no key is hot.

Where all plans but the last leave paths as they are, every plan names a row by
the same path: ``compose_in_place`` then needs one aggregation by path, however
many plans there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.plans.apply import ATTRIBUTES, DELETE_ACTIONS, MOVE_ACTIONS

COLUMNS = ["path", "action", "dest", "size", "md5", "reason", *ATTRIBUTES]
_KINDS = {"dest": "string", "size": "bigint", "md5": "string", "reason": "string"} | dict.fromkeys(ATTRIBUTES, "int")


def effects(plan: DataFrame, reason: str | None = None) -> DataFrame:
    """The rows of a plan that change something, as ``COLUMNS``: action is
    'delete', 'rmdir', 'move' or 'chmod'.  Chmod rows of a path that another
    row moves or removes belong to that row; there are none in one verb's plan."""
    def given(column):
        if column == "reason" and reason is not None:
            return F.lit(reason).alias(column)
        return (F.col(column) if column in plan.columns else F.lit(None)).cast(_KINDS[column]).alias(column)

    action = (F.when(F.col("action") == "rmdir", "rmdir").when(F.col("action").isin(list(DELETE_ACTIONS)), "delete")
              .when(F.col("action").isin(list(MOVE_ACTIONS)), "move").when(F.col("action") == "chmod", "chmod"))
    return plan.select("path", action.alias("action"), *[given(c) for c in COLUMNS[2:]]).where("action is not null")


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    gone = F.col("action").isin("delete", "rmdir")
    # a removed row is nowhere: its place is null and meets nothing
    a = first.select(F.when(~gone, F.coalesce(F.when(F.col("action") == "move", F.col("dest")), F.col("path"))).alias("_at"),
                     F.struct(*COLUMNS).alias("_a"))
    b = second.select(F.col("path").alias("_at"), F.struct(*COLUMNS).alias("_b"))
    j = a.join(b, "_at", "full")
    path = F.coalesce("_a.path", "_b.path")
    removed = F.coalesce(F.when(F.col("_a.action").isin("delete", "rmdir"), F.col("_a.action")),
                         F.when(F.col("_b.action").isin("delete", "rmdir"), F.col("_b.action")))
    dest = F.coalesce(F.when(F.col("_b.action") == "move", F.col("_b.dest")), F.when(F.col("_a.action") == "move", F.col("_a.dest")))
    dest = F.when(removed.isNull() & (dest != path), dest)
    sets = {c: F.when(removed.isNull(), F.coalesce(f"_b.{c}", f"_a.{c}")) for c in ATTRIBUTES}
    changed = reduce(lambda x, y: x | y, [c.isNotNull() for c in sets.values()])
    action = F.when(removed.isNotNull(), removed).when(dest.isNotNull(), "move").when(changed, "chmod")
    last = F.when(F.col("_a.action").isin("delete", "rmdir"), F.col("_a.reason")).otherwise(F.coalesce("_b.reason", "_a.reason"))
    return j.select(path.alias("path"), action.alias("action"), dest.alias("dest"), F.coalesce("_a.size", "_b.size").alias("size"),
                    F.coalesce("_a.md5", "_b.md5").alias("md5"), last.alias("reason"),
                    *[v.alias(c) for c, v in sets.items()]).where("action is not null")


def compose(*plans: DataFrame) -> DataFrame:
    """One plan (``COLUMNS``) with the effect of ``plans`` one after another:
    ``apply_plan(m, compose(p, q))`` has the rows of
    ``apply_plan(apply_plan(m, p), q)``."""
    return reduce(_compose, [effects(p) for p in plans])


def compose_in_place(*plans: DataFrame) -> DataFrame:
    """``compose`` for plans of which none but the last moves anything."""
    rows = reduce(DataFrame.unionByName, [effects(p).withColumn("_step", F.lit(i)) for i, p in enumerate(plans)])
    gone = F.col("action").isin("delete", "rmdir")

    def of(column, which, first=False):
        return (F.min_by if first else F.max_by)(column, F.when(which, F.col("_step")))

    removed = of("action", gone, first=True)
    sets = {c: F.when(removed.isNull(), of(c, F.col(c).isNotNull())) for c in ATTRIBUTES}
    r = rows.groupBy("path").agg(
        removed.alias("_removed"), of("dest", F.col("action") == "move").alias("_dest"), of("size", F.col("size").isNotNull(), True).alias("size"),
        of("md5", F.col("md5").isNotNull(), True).alias("md5"), of("reason", gone, True).alias("_why"),
        of("reason", F.col("reason").isNotNull()).alias("_last"), *[v.alias(c) for c, v in sets.items()])
    dest = F.when(F.col("_removed").isNull() & (F.col("_dest") != F.col("path")), F.col("_dest"))
    changed = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in ATTRIBUTES])
    action = F.coalesce("_removed", F.when(dest.isNotNull(), "move").when(changed, "chmod"))
    why = F.when(F.col("_removed").isNotNull(), F.col("_why")).otherwise(F.col("_last"))
    return r.select("path", action.alias("action"), dest.alias("dest"), "size", "md5", why.alias("reason"), *ATTRIBUTES).where("action is not null")
