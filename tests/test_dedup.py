from pyspark.sql import functions as F

from filelake.operators import dedup as D
from filelake.plans.apply import apply_plan
from filelake.sources.manifest import from_table

DUP = "duplicate content"


def _sample(mk):
    rows = [("/t/unique1.txt", "unique content 1"), ("/t/unique2.txt", "unique content 2"),
            ("/t/subdir1/file.txt", DUP), ("/t/subdir2/file.txt", DUP), ("/t/subdir1/deep/file.txt", DUP),
            ("/t/file - Copy.txt", DUP), ("/t/file - copie.txt", DUP), ("/t/file (1).txt", DUP),
            ("/t/file (2).txt", DUP), ("/t/small.txt", "x")]
    return mk(rows)


def test_sample_group_and_keeper(mk):
    plan = D.dedup_plan(_sample(mk), "/t", min_size=10).collect()
    assert len(plan) == 7
    keep = [r for r in plan if r.action == "keep"]
    assert len(keep) == 1 and keep[0].path == "/t/file (1).txt"
    assert all(r.keeper_path == "/t/file (1).txt" for r in plan)
    s = D.dedup_summary(_sample(mk), "/t", min_size=10).first()
    assert (s.total_files, s.duplicate_groups, s.files_to_delete, s.space_to_free) == (9, 1, 6, 6 * len(DUP))


def test_min_size_excludes_everything(mk):
    s = D.dedup_summary(_sample(mk), "/t").first()  # default 1024
    assert (s.total_files, s.duplicate_groups) == (0, 0)


def test_skip_dirs_default_and_custom(mk):
    rows = [("/t/file1.txt", "same ten bytes"), ("/t/node_modules/file2.txt", "same ten bytes"),
            ("/t/.git/file3.txt", "same ten bytes"), ("/t/.Trash-1000/f.txt", "same ten bytes")]
    m = mk(rows)
    assert D.candidates(m, "/t", min_size=10).select("path").collect() == [("/t/file1.txt",)]
    got = {r.path for r in D.candidates(m, "/t", min_size=10, skip_dirs=[".git"]).collect()}
    assert got == {"/t/file1.txt", "/t/node_modules/file2.txt", "/t/.Trash-1000/f.txt"}


def test_root_below_skipped_name_is_not_pruned(mk):
    m = mk([("/x/node_modules/r/a.txt", "0123456789"), ("/x/node_modules/r/b.txt", "0123456789")])
    assert D.dedup_summary(m, "/x/node_modules/r", min_size=5).first().duplicate_groups == 1


def test_filters_symlink_hidden_zero_globs(mk):
    rows = [("/t/a.jpg", "0123456789", False), ("/t/b.jpg", "0123456789", True),
            ("/t/.c.jpg", "0123456789", False), ("/t/d.png", "0123456789", False),
            ("/t/e.txt", "", False)]
    m = mk(rows, "is_symlink boolean")
    got = {r.path for r in D.candidates(m, "/t", min_size=0, include=["*.jpg", "*.png"], exclude=["d*"]).collect()}
    assert got == {"/t/a.jpg"}


def test_size_groups(mk):
    m = mk([("/t/a", "x" * 100), ("/t/b", "y" * 100), ("/t/c", "z" * 200)])
    assert D.shared_sizes(D.candidates(m, "/t", min_size=1)).collect()[0]["size"] == 100


def test_strategies(mk, spark):
    rows = [("/t/a/x.bin", DUP * 3, 10), ("/t/b.bin", DUP * 3, 30), ("/t/c.bin", DUP * 3, 30)]
    m = mk(rows, "mtime_s bigint")
    keeper = lambda s: D.dedup_plan(m, "/t", 1, s).filter("action = 'keep'").first().path
    assert keeper("newest") == "/t/b.bin"       # latest mtime, ties by path
    assert keeper("largest") == "/t/a/x.bin"    # equal sizes -> first path
    assert keeper("deepest") == "/t/b.bin"      # fewest parts, then shorter path


def test_unreadable_files_not_grouped(spark):
    df = spark.createDataFrame([("/t/a", 50, None), ("/t/b", 50, None)], "path string, size bigint, md5 string")
    s = D.dedup_summary(df, "/t", min_size=1).first()
    assert (s.total_files, s.duplicate_groups) == (2, 0)


def test_content_path_hashes_only_shared_sizes(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "aaaa"), (3, "bbbbbbbb"), (4, "cc")], "id int, text string")
    m = from_table(docs, "concat('/t/', cast(id as string), '.txt')", "text")
    plan = D.dedup_plan(m, "/t", min_size=1)
    assert {(r.path, r.action) for r in plan.collect()} == {("/t/1.txt", "keep"), ("/t/2.txt", "delete")}
    # size pre-filter before md5: only the rows of a shared size were hashed and stored
    assert {r.path for r in D.hashed(D.candidates(m, "/t", 1)).collect()} == {"/t/1.txt", "/t/2.txt"}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # content is hashed next to the scan: no shuffle ever carries it
    phys = plan._jdf.queryExecution().executedPlan().toString()
    for line in phys.splitlines():
        if "Exchange" in line and "Broadcast" not in line:
            assert "text" not in line and "content" not in line


def test_content_path_with_large_size_list(spark, monkeypatch):
    monkeypatch.setattr(D, "SIZE_BITS", 0)  # a full bitmap passes every row: the exact join decides
    docs = spark.createDataFrame([(1, "aaaa"), (2, "aaaa"), (3, "bbbbbbbb"), (4, "cc")], "id int, text string")
    m = from_table(docs, "concat('/t/', cast(id as string), '.txt')", "text")
    plan = D.dedup_plan(m, "/t", min_size=1)
    assert {(r.path, r.action) for r in plan.collect()} == {("/t/1.txt", "keep"), ("/t/2.txt", "delete")}


def test_invariants_after_apply(mk):
    m = _sample(mk)
    plan = D.dedup_plan(m, "/t", min_size=10)
    per_group = plan.groupBy("md5").agg(F.count_if(F.col("action") == "keep").alias("k")).collect()
    assert all(r.k == 1 for r in per_group)
    after = apply_plan(m, plan)
    assert after.count() == after.select("path").distinct().count()
    assert D.dedup_plan(after, "/t", min_size=10).count() == 0
    deleted = plan.filter("action = 'delete'").select("md5").distinct()
    assert deleted.join(after, "md5", "left_anti").count() == 0  # content still exists


def test_hot_group_third_of_rows(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.format_string("/t/d%03d/f%05d.bin", F.col("id") % 500, F.col("id")).alias("path"),
        F.lit(4096).cast("bigint").alias("size"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.md5(F.col("id").cast("string"))).alias("md5"))
    plan = D.dedup_plan(rows, "/t", min_size=1)
    s = D.dedup_summary(rows, "/t", min_size=1).first()
    assert (s.duplicate_groups, s.files_to_delete) == (1, n // 3 - 1)
    assert plan.filter("action = 'keep'").first().path == "/t/d000/f00000.bin"
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
