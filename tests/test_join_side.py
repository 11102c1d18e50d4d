"""Joins to a side with hot keys: the same rows by every way."""
import pytest
from pyspark.sql import functions as F

from filelake import session
from filelake.operators import dedup
from filelake.plans.apply import verify_plan
from filelake.session import join_side


def _rows(spark):
    hot = spark.range(40).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    cold = spark.range(9).select(F.concat(F.lit("k"), F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    null = spark.range(2).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("v"))
    return hot.unionByName(cold).unionByName(null)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_by_every_way(spark, how):
    rows = _rows(spark)
    side = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3), ("other", 4)], "k string, s int")
    want = sorted(map(str, rows.join(side, ["k"], how).collect()))
    assert len(want) == (51 if how == "left" else 45)
    for bounds in ({}, {"max_rows": 0}, {"max_rows": 0, "hot_rows": 5}):
        assert sorted(map(str, join_side(rows, side, ["k"], how, **bounds).collect())) == want


def test_empty_side_and_no_rows(spark):
    rows, side = _rows(spark), spark.createDataFrame([], "k string, s int")
    assert join_side(rows, side, ["k"], "left", max_rows=-1, hot_rows=5).count() == 51
    assert join_side(rows.limit(0), side, ["k"], "left", max_rows=-1, hot_rows=5).count() == 0


def test_plan_and_verify_do_not_change_beyond_the_bounds(spark, monkeypatch):
    man = spark.createDataFrame([(f"/a/{i}.txt", 2000, "h" if i < 12 else f"u{i // 2}") for i in range(20)],
                                "path string, size bigint, md5 string")
    now = man.filter("path != '/a/3.txt'").withColumn("size", F.when(F.col("path") == "/a/5.txt", 1).otherwise(F.col("size")))

    def run():
        plan = dedup.dedup_plan(man, "/a")
        return sorted(map(str, plan.collect())), sorted(map(str, verify_plan(plan, now).collect()))

    whole = run()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "HOT_KEY_ROWS", 3)
    assert run() == whole


def test_counts_are_taken_while_a_step_is_written(spark):
    from filelake.session import materialize_counted, small_side
    rows = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") % 10)
    stored, seen = materialize_counted(rows, "t", zero=F.count_if(F.col("k") == 0), few=F.count_if(F.col("id") < 3))
    assert dict(seen) == {"rows": 1000, "zero": 100, "few": 3} and stored.count() == 1000 and stored.columns == ["id", "k"]
    for none in (rows.limit(0), rows.where("id < 0"), rows.join(rows.where("id < 0").select("k"), "k"), spark.createDataFrame([], "id long, k long")):
        stored, seen = materialize_counted(none, "none", zero=F.count_if(F.col("k") == 0))
        assert dict(seen) == {"rows": 0, "zero": 0} and stored.count() == 0
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_side(rows, "t", 1000)) and not hinted(small_side(rows, "t", 999))
    assert hinted(small_side(rows, "t", 10, store=False, at_most=10))  # the given bound is taken
    assert not hinted(small_side(rows, "t", 10, store=False, at_most=2000)) and hinted(small_side(rows, "t", 1000, store=False, at_most=2000))


def test_rename_and_sort_run_few_jobs(spark):
    from filelake.operators import rename, sort
    names = [f"/r/a/f{i}.txt" for i in range(20)] + [f"/r/a/f{i} (1).txt" for i in range(30)] + ["/r/Documents/f3.txt"]
    man = spark.createDataFrame([(p, 10 + i % 3, f"m{i % 4}") for i, p in enumerate(names)], "path string, size long, md5 string").cache()
    man.count()
    sc = spark.sparkContext
    for group, run in (("rename-jobs", lambda: rename.rename_plan(man, "/r")), ("sort-jobs", lambda: sort.sort_plan(man, "/r"))):
        sc.setJobGroup(group, group)
        try:
            assert run().count() > 0
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(sc.statusTracker().getJobIdsForGroup(group)) <= 14
