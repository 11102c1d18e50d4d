"""Collision-free destination names (JN7, WN5), shared by sort, rename and
consolidate.

Each mover wants ``dir/stem+suffix``; slot 0 is that bare name, slot k is
``stem_k+suffix``.  Slots already taken (existing files, and other movers'
bare names that look like ``stem_k+suffix``) are skipped; the r-th mover of
a group (in the given order, path by default) gets the r-th free slot.

With the taken slots of a group sorted as t_0 < t_1 < ... the r-th free slot
is ``r + #{i : t_i - i <= r}``.  One sweep over a group's rows gives both numbers:
its taken slots in order, then its movers in order, are numbered by running
sums; put at ``t_i - i`` and r, a second running sum counts the taken slots before
each mover.  So the work is movers plus taken slots, never their product.

Work per call: existing names are cut to the destination folders (semi join on the
distinct folders) and exploded into the (group, slot) keys they occupy; they
and the movers are shuffled once, by group, and sorted twice where they are.
Nothing is stored.

Hot groups: a group has no more rows than there are, so where that is at most
``hot_rows`` there is nothing to look for.  Beyond it, one aggregation finds the
groups with more than ``hot_rows`` rows -- at most rows / hot_rows of them, a proven
bound, so broadcast.  Their rows are swept in the same orders by range
partitionings on (group, order), which split a group at any row; the totals per
group and range give the offsets.  A group's size never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.session import materialize

HOT_GROUP_ROWS = 2_000_000
_SLOT_SUFFIX = r"^(.*)_([1-9][0-9]*)$"
_K = ["_d", "_s", "_x"]


def name_slots(dir_col: Column, name_col: Column, bare: bool = True) -> Column:
    """Array of (d, s, x, slot) keys a name occupies: its own bare name
    (slot 0) and, when the stem ends in ``_<k>``, slot k of the shorter stem."""
    suffix = P.raw_suffix(name_col)
    stem = P.stem_of(name_col)
    k = F.regexp_extract(stem, _SLOT_SUFFIX, 2)
    as_k = F.struct(dir_col.alias("_d"), F.regexp_extract(stem, _SLOT_SUFFIX, 1).alias("_s"),
                    suffix.alias("_x"), k.try_cast("int").alias("slot"))
    own = F.struct(dir_col.alias("_d"), stem.alias("_s"), suffix.alias("_x"), F.lit(0).alias("slot"))
    empty = F.array().cast("array<struct<_d:string,_s:string,_x:string,slot:int>>")
    arr_k = F.when(k != "", F.array(as_k)).otherwise(empty)
    return F.concat(F.array(own), arr_k) if bare else arr_k


def taken_slots(m: DataFrame, dir_col: str, name_col: str, existing: DataFrame) -> DataFrame:
    """Rows (group, slot) of every slot taken by an existing name or by the look
    of a mover's own name; a slot may come more than once.  Existing names are
    first cut to the destination folders (semi join on the distinct folders, a
    runtime-sized aggregate)."""
    dirs = m.select(F.col(dir_col).alias("dir")).distinct()
    ex = existing.join(dirs, "dir", "left_semi")
    return (ex.select(F.explode(name_slots(F.col("dir"), F.col("name"))).alias("t"))
            .unionByName(m.select(F.explode(name_slots(F.col(dir_col), F.col(name_col), bare=False)).alias("t")))
            .select("t._d", "t._s", "t._x", F.col("t.slot").alias("_slot"))
            .where("_slot is not null"))  # a number beyond every slot takes none


def _running(value: Column, order: list[Column], *more: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*_K, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _sweep(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``_free``: the slot of each mover.  ``rows``: movers (``_kind`` 1) and taken
    slots (``_kind`` 0, ``_slot``).  Both windows are by group: one shuffle."""
    first = [F.col("_kind"), F.col("_slot"), *order]
    w = Window.partitionBy(*_K).orderBy(*first)
    new = (F.col("_kind") == 0) & ~F.col("_slot").eqNullSafe(F.lag("_slot").over(w))
    r = rows.withColumn("_new", new.cast("int"))
    r = r.withColumns({"_i": _running(F.col("_new"), first), "_r": _running(F.col("_kind"), first)})
    return _placed(r).withColumn("_before", _running(1 - F.col("_kind"), [F.col("_at"), F.col("_kind")])).transform(_slotted)


def _placed(numbered: DataFrame) -> DataFrame:
    """Each taken slot once at ``t_i - i``, each mover at its rank."""
    at = F.when(F.col("_kind") == 1, F.col("_r") - 1).otherwise(F.col("_slot") - (F.col("_i") - 1))
    return numbered.where("_kind = 1 or _new = 1").withColumn("_at", at.cast("bigint"))


def _slotted(r: DataFrame) -> DataFrame:
    return r.where("_kind = 1").withColumn("_free", F.col("_at") + F.col("_before")).drop("_new", "_i", "_r", "_at", "_before")


def _sweep_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``_sweep`` for groups too large for one task."""
    slots = rows.where("_kind = 0").select(*_K, "_slot").distinct().withColumns({"_kind": F.lit(0), "_new": F.lit(1)})
    taken = _by_range(slots, [F.col("_slot")], F.col("_new"), "_i").withColumn("_r", F.lit(0).cast("bigint"))
    movers = _by_range(rows.where("_kind = 1").withColumn("_new", F.lit(0)), order, F.col("_kind"), "_r").withColumn("_i", F.lit(0).cast("bigint"))
    both = _placed(movers.unionByName(taken, allowMissingColumns=True))
    return _by_range(both, [F.col("_at"), F.col("_kind")], 1 - F.col("_kind"), "_before").transform(_slotted)


def _by_range(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over a group's rows up to each row by
    ``order``.  The ranges are written before they are summed."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(rows.repartitionByRange(parts, *_K, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*_K).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per hot group and range: a proven bound
    shift = F.broadcast(t.groupBy(*_K, "_p").agg(F.sum(value).alias("_c0"))
                        .select(*_K, "_p", F.coalesce(F.sum("_c0").over(before), F.lit(0)).alias("_s0")))
    return (t.withColumn(name, _running(value, order, "_p")).join(shift, [*_K, "_p"])
             .withColumn(name, (F.col(name) + F.col("_s0")).cast("bigint")).drop("_p", "_s0"))


def assign_slots(movers: DataFrame, dir_col: str, name_col: str, existing: DataFrame,
                 order: list[Column] | None = None, hot_rows: int = HOT_GROUP_ROWS,
                 n_movers: int | None = None) -> DataFrame:
    """Add ``dest_name`` and ``dest`` to each mover.

    ``existing``: (dir, name) rows occupying names in destination folders.
    ``order``: which mover of a group comes first (default: path).
    ``n_movers``: the number of movers, where the caller saw it as they were written.
    """
    order = order or [F.col("path")]
    name = F.col(name_col)
    m = movers.withColumns({"_d": F.col(dir_col), "_s": P.stem_of(name), "_x": P.raw_suffix(name)})
    taken = taken_slots(m, dir_col, name_col, existing)
    rows = m.withColumn("_kind", F.lit(1)).unionByName(taken.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    # no group has more rows than there are: a mover or a name is at most one row of a group (the slot
    # it looks like belongs to the group of a shorter stem)
    most = (existing.select(F.lit(1)).count() + n_movers if n_movers is not None
            else movers.select(F.lit(1)).unionAll(existing.select(F.lit(1))).count())
    hot = None
    if most > hot_rows:
        hot = materialize(rows.groupBy(*_K).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*_K), "hot")
        hot = None if hot.isEmpty() else F.broadcast(hot)  # at most rows / hot_rows groups: a proven bound
    if hot is None:
        r = _sweep(rows, order)
    else:
        r = _sweep(rows.join(hot, _K, "left_anti"), order).unionByName(_sweep_ranges(rows.join(hot, _K, "left_semi"), order))
    slot = F.col("_free")
    dest_name = F.when(slot == 0, name).otherwise(F.concat(F.col("_s"), F.lit("_"), slot.cast("string"), F.col("_x")))
    d = F.col(dir_col)
    return (r.withColumn("dest_name", dest_name)
             .withColumn("dest", F.when(d.endswith("/"), F.concat(d, "dest_name"))
                         .otherwise(F.concat(d, F.lit("/"), F.col("dest_name"))))
             .drop(*_K, "_kind", "_slot", "_free"))
