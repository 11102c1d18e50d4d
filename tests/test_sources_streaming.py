import hashlib
import os

from pyspark.sql import functions as F

from filelake.operators import dedup as D
from filelake.plans import oplog as OL
from filelake.sources.files import hash_paths, list_files
from filelake.sources.manifest import from_inventory
from filelake.streaming import extension_totals_stream, pending_ops_stream


def _tree(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_list_and_hash_real_tree(spark, tmp_path):
    big = os.urandom(200_000)  # several 64 KB chunks
    _tree(tmp_path, {"a/x.bin": big, "b/x.bin": big, "c/y.bin": b"other" * 40_000, "d/z.txt": b"tiny"})
    files = list_files(spark, str(tmp_path))
    assert files.count() == 4
    h = {r.path.rsplit("/", 2)[-2]: r.md5 for r in hash_paths(files).collect()}
    assert h["a"] == hashlib.md5(big).hexdigest() == h["b"]
    plan = D.dedup_plan(files, str(tmp_path), min_size=1).collect()
    assert sorted(r.action for r in plan) == ["delete", "keep"]


def test_unreadable_file_is_null(spark):
    df = spark.createDataFrame([("/nonexistent/file.bin", 10)], "path string, size bigint")
    assert hash_paths(df).first().md5 is None


def test_from_inventory_renames(spark, tmp_path):
    inv = spark.createDataFrame([("/r/a.txt", 5)], "key string, bytes int")
    inv.write.parquet(str(tmp_path / "inv"))
    m = from_inventory(spark, str(tmp_path / "inv"), rename={"key": "path", "bytes": "size"})
    assert m.schema["size"].dataType.simpleString() == "bigint" and m.first().path == "/r/a.txt"


def test_pending_ops_stream(spark, tmp_path):
    log_dir = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "delete", "/r/a"), ("b", "delete", "/r/b")], "op_id string, op_type string, source string")
    first = OL.op_log_update(rows.withColumn("dest", F.lit(None).cast("string"))
                             .withColumn("hash", F.lit(None).cast("string"))
                             .withColumn("expected_size", F.lit(1).cast("bigint")), "pending", 0)
    OL.append_op_log(first, log_dir)
    q = (pending_ops_stream(spark, log_dir).writeStream.outputMode("complete").format("memory")
         .queryName("pending_ops").option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
        OL.append_op_log(OL.op_log_update(first.filter("op_id = 'a'"), "done", 1), log_dir)
        q.processAllAvailable()
        got = {r.op_id: r.is_pending for r in spark.sql("SELECT * FROM pending_ops").collect()}
        assert got == {"a": False, "b": True}
    finally:
        q.stop()


def test_extension_totals_stream(spark, tmp_path):
    inv_dir = str(tmp_path / "inv")
    spark.createDataFrame([("/r/a.txt", 3), ("/r/b.TXT", 4)], "path string, size bigint").write.parquet(inv_dir)
    q = (extension_totals_stream(spark, inv_dir, "path string, size bigint").writeStream.outputMode("complete")
         .format("memory").queryName("ext_totals").option("checkpointLocation", str(tmp_path / "ck2")).start())
    try:
        q.processAllAvailable()
        got = {r.ext: (r["count"], r.size_bytes) for r in spark.sql("SELECT * FROM ext_totals").collect()}
        assert got == {".txt": (2, 7)}
    finally:
        q.stop()


def test_partitioned_manifest_prunes(spark, mk, tmp_path):
    from filelake.operators import snapshot as S
    from filelake.sources.manifest import write_manifest
    m = mk([("/lake/a/x/1.txt", "0123456789"), ("/lake/a/2.txt", "0123456789"),
            ("/lake/b/3.txt", "0123456789"), ("/lake/node_modules/4.txt", "0123456789"), ("/lake/5.txt", "xx")])
    loc = str(tmp_path / "inv")
    write_manifest(m, loc, "/lake")
    stored = spark.read.parquet(loc)
    plan = D.dedup_plan(stored, "/lake/a", min_size=1)
    assert {r.path for r in plan.collect()} == {"/lake/a/x/1.txt", "/lake/a/2.txt"}
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    files = S.snapshot_files(stored, "/lake")
    assert {r.path for r in files.collect()} == {"/lake/a/x/1.txt", "/lake/a/2.txt", "/lake/b/3.txt", "/lake/5.txt"}
    scan = [ln for ln in files._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    assert scan and "PartitionFilters: [" in scan[0] and "top_dir" in scan[0].split("PartitionFilters")[1]
    # a different root over the same store is not pruned wrongly
    assert {r.path for r in S.snapshot_files(stored, "/").collect()} == {
        "/lake/a/x/1.txt", "/lake/a/2.txt", "/lake/b/3.txt", "/lake/5.txt"}


def test_rename_and_consolidate_on_a_real_tree(spark, tmp_path):
    from filelake.operators import consolidate as CO
    from filelake.operators import rename as RN
    body = b"same bytes " * 20
    _tree(tmp_path, {"docs/a.txt": body, "docs/a (1).txt": body, "docs/b - Copy.txt": b"only copy" * 20,
                     "lib/keep.txt": b"kept " * 40, "docs/keep.txt": b"kept " * 40})
    root = str(tmp_path)
    files = list_files(spark, root)
    got = {r.path.rsplit("/", 1)[1]: r.action for r in RN.rename_plan(files, root).collect()}
    assert got == {"a (1).txt": "delete_duplicate", "b - Copy.txt": "rename"}
    cons = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[1]: r.action
            for r in CO.consolidate_plan(files, root, root + "/lib").collect()}
    assert cons["docs/keep.txt"] == "delete" and cons["docs/a.txt"] == "move"


def test_listing_is_complete(spark, tmp_path):
    from filelake.operators import clean as CLN
    from filelake.sources.manifest import from_files
    _tree(tmp_path, {"_x/_y.txt": b"1", ".y": b"22", "a/.DS_Store": b"333", "a/b c/é.txt": b""})
    (tmp_path / "hollow" / "deep").mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    root = str(tmp_path)
    rows = {r.path[len(root) + 1:]: r for r in from_files(spark, root).collect()}
    assert set(rows) == {"_x", "_x/_y.txt", ".y", "a", "a/.DS_Store", "a/b c", "a/b c/é.txt", "hollow", "hollow/deep", "link"}
    assert {p for p, r in rows.items() if r.is_dir} == {"_x", "a", "a/b c", "hollow", "hollow/deep"}
    assert rows["link"].is_symlink and not rows["link"].is_dir and rows[".y"].size == 2
    assert rows["a"].mode == (tmp_path / "a").stat().st_mode & 0o7777 and rows["a"].uid == os.getuid()
    m = from_files(spark, root)
    plan = CLN.clean_plan(m, root, dirs=m.filter("is_dir").select("path"))
    got = {(r.path[len(root) + 1:], r.action) for r in plan.filter("action <> 'chmod'").collect()}
    assert got == {("a/.DS_Store", "delete"), ("hollow", "rmdir"), ("hollow/deep", "rmdir")}
    assert list_files(spark, root).filter("size >= 2 and not is_symlink").count() == 2


def test_empty_root_and_missing_root_list_nothing(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).count() == 0
    assert list_files(spark, str(tmp_path / "none")).count() == 0


def test_content_is_hashed_once_and_never_shuffled(spark, tmp_path):
    rows = [(f"/r/a{i}.txt", "same" * 9 if i % 3 else f"other {i}") for i in range(12)]
    spark.createDataFrame(rows, "path string, content string").selectExpr("*", "cast(octet_length(content) as bigint) size") \
        .write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    from filelake.operators import consolidate as CO
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [D.dedup_plan(m, "/r", min_size=1), CO.consolidate_plan(m, "/r", "/r/lib", min_size=1)]
        for plan in plans:  # later branches read narrow stored rows
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "content#" not in text
        assert plans[0].count() == 8
        raw = m.filter("size > 0")
        sizes = D.shared_sizes(raw).select("size")
        cut = raw.withColumn("word", F.shiftright(F.pmod(F.xxhash64("size"), F.lit(1 << D.SIZE_BITS)), 6)).join(
            F.broadcast(D.size_filter(sizes)), "word")
        physical = cut._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in physical and "BroadcastHashJoin" in physical
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
