from pyspark.sql import functions as F

from filelake.operators import dedup as D
from filelake.operators import sort as SO
from filelake.plans import batches as BA
from filelake.plans import oplog as OL
from filelake.plans.apply import apply_plan, verify_plan
from filelake.plans.workflow import reorganize

DUP = "duplicate content!!"


def test_apply_moves_and_deletes(mk):
    m = mk([("/r/a.pdf", "1"), ("/r/x/b.pdf", "2"), ("/r/c.mp3", "3")])
    after = apply_plan(m, SO.sort_plan(m, "/r", "mixed"))
    assert sorted(r.path for r in after.collect()) == ["/r/Documents/a.pdf", "/r/Documents/b.pdf", "/r/Music/c.mp3"]


def test_verify(mk, spark):
    m = mk([("/r/a.txt", DUP), ("/r/b/a.txt", DUP), ("/r/c.txt", DUP + "!"), ("/r/d/c.txt", DUP + "!"),
            ("/r/e.txt", DUP + "?"), ("/r/f/e.txt", DUP + "?")])
    plan = D.dedup_plan(m, "/r", min_size=1)
    cur = spark.createDataFrame([("/r/a.txt", len(DUP)), ("/r/c.txt", 999), ("/r/d/c.txt", len(DUP) + 1),
                                 ("/r/e.txt", len(DUP) + 1), ("/r/f/e.txt", 5)], "path string, size bigint")
    got = {r.path: r.status for r in verify_plan(plan, cur).collect()}
    assert got["/r/b/a.txt"] == "already_gone"
    assert got["/r/d/c.txt"] == "keeper_changed"
    assert got["/r/f/e.txt"] == "size_changed"
    assert got["/r/a.txt"] == "ok"


def test_oplog_round_trip(mk, spark, tmp_path):
    m = mk([("/r/a.txt", DUP), ("/r/b/a.txt", DUP), ("/r/c.txt", DUP), ("/r/d/c.txt", DUP)])
    plan = D.dedup_plan(m, "/r", min_size=1)
    log = OL.op_log_from_plan(plan, seq=0)
    loc = str(tmp_path / "oplog")
    OL.append_op_log(log, loc)
    first = log.orderBy("source").limit(1)
    OL.append_op_log(OL.op_log_update(first, "done", 1), loc)
    back = OL.load_op_log(spark, loc)
    assert back.count() == 4
    assert OL.op_log_recover(back).count() == 2
    assert OL.load_op_log(spark, str(tmp_path / "missing")).count() == 0


def test_batches_are_exact(spark):
    plan = spark.range(0, 2345).select(F.format_string("/r/f%05d", "id").alias("path"),
                                       F.lit("delete").alias("action"), F.lit(1).cast("bigint").alias("size"))
    b = BA.delete_batches(plan.repartition(7), 500)
    rows = b.select("path", "idx", "batch_id").collect()
    assert sorted(r.idx for r in rows) == list(range(2345))
    assert all(r.idx == int(r.path[4:]) and r.batch_id == r.idx // 500 for r in rows)


def test_reorganize(mk):
    m = mk([("/r/a/x.pdf", DUP), ("/r/b/x.pdf", DUP), ("/r/c/y.mp3", "song" * 10), ("/r/Thumbs.db", "junk")])
    r = reorganize(m, "/r", dedup_min_size=1)
    s = r.summary().first()
    assert (s.junk_deleted, s.duplicates_deleted, s.files_sorted, s.files_before, s.files_after) == (1, 1, 2, 4, 2)
    assert sorted(x.path for x in r.final_manifest.collect()) == ["/r/Documents/x.pdf", "/r/Music/y.mp3"]


def test_batches_exact_on_shuffled_input(spark):
    # input straight out of a shuffle: row order inside partitions varies between reads
    base = spark.range(0, 20000).groupBy((F.col("id") * 7919 % 20000).alias("k")).agg(F.count("*").alias("c"))
    plan = base.select(F.format_string("/r/f%05d", "k").alias("path"), F.lit("delete").alias("action"),
                       F.lit(1).cast("bigint").alias("size"))
    rows = BA.delete_batches(plan, 500).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in rows) == [500] * 40


def test_verify_move_plan_dest_exists(mk, spark):
    m = mk([("/r/a.pdf", "1"), ("/r/x/b.pdf", "2")])
    plan = SO.sort_plan(m, "/r", "mixed")
    cur = spark.createDataFrame([("/r/a.pdf", 1), ("/r/x/b.pdf", 1), ("/r/Documents/b.pdf", 7)], "path string, size bigint")
    got = {r.path: r.status for r in verify_plan(plan, cur).collect()}
    assert got == {"/r/a.pdf": "ok", "/r/x/b.pdf": "dest_exists"}


def test_apply_invariants_on_fixture(spark):
    from pathlib import Path

    import pytest

    from filelake.operators import clean as CLN
    from filelake.operators import consolidate as CO
    from filelake.operators import rename as RN
    from filelake.sources import fixture as FX
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("test data not present")
    m = FX.manifest(spark, sf)
    n = m.count()
    plans = {
        "dedup": D.dedup_plan(m, FX.ROOT, min_size=100),
        "sort": SO.sort_plan(m, FX.ROOT),
        "consolidate": CO.consolidate_plan(m, FX.ROOT, FX.TARGET),
        "rename": RN.rename_plan(m, FX.ROOT),
        "junk": CLN.junk_plan(m, FX.ROOT),
    }
    for name, plan in plans.items():
        deletes = plan.filter(F.col("action").isin("delete", "delete_duplicate")).count()
        after = apply_plan(m, plan)
        assert after.count() == n - deletes, name
        assert after.select("path").distinct().count() == n - deletes, name  # no two rows end on one path
    after = apply_plan(m, plans["dedup"])
    assert D.dedup_plan(after, FX.ROOT, min_size=100).count() == 0
    perms = CLN.permission_plan(m)
    fixed = apply_plan(m, perms)
    assert CLN.permission_plan(fixed).count() == 0


def test_work_planned_again_is_not_hidden_by_an_earlier_run(spark):
    plan = spark.createDataFrame([("/a", "delete")], "path string, action string")
    first = OL.op_log_from_plan(plan, run="one")
    log = first.unionByName(OL.op_log_update(first, "done", 1)).unionByName(OL.op_log_from_plan(plan, run="two"))
    assert [r.status for r in OL.op_log_recover(log).collect()] == ["pending"]


def test_a_damaged_log_is_an_error(spark, tmp_path):
    import pytest
    (tmp_path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        OL.load_op_log(spark, str(tmp_path)).collect()
