import os

import pytest
from pyspark.sql import functions as F

from filelake.operators import clean as CLN
from filelake.sources import files as SF
from filelake.sources.manifest import from_files


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    top = tmp_path_factory.mktemp("flat")
    for i in range(100_000):
        os.close(os.open(top / f"n{i}", os.O_CREAT | os.O_WRONLY))
    (top / "n7").write_text("seven")
    return str(top)


def test_a_flat_folder_is_listed_by_several_tasks(spark, flat):
    t = SF.list_tree(spark, flat)
    assert t.count() == 100_000 and t.select("path").distinct().count() == 100_000
    assert t.where("error is not null").isEmpty() and t.where("size = 5").first().path.endswith("/n7")
    parts = t.groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 80_000


def test_folder_listing_source(spark, flat):
    spark.dataSource.register(SF.folder_listing())
    df = spark.read.format("folder_listing").option("path", flat).load()
    n = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(n) == 5 and sum(r["count"] for r in n) == 100_000 and min(r["count"] for r in n) > 15_000
    assert spark.read.format("folder_listing").option("path", flat).option("ranges", 3).load().rdd.getNumPartitions() == 3
    key = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        spark.dataSource.register(SF.folder_listing(pushdown=True))
        found = spark.read.format("folder_listing").option("path", flat).load().where("size >= 5 and path like '%n7'")
        assert [r.size for r in found.collect()] == [5]
    finally:
        spark.conf.set(key, old)


@pytest.fixture
def deep(tmp_path):
    """A chain of folders whose last ones have paths too long to be read, as a
    folder without permission has (root may read those)."""
    top = tmp_path / "t"
    (top / "empty").mkdir(parents=True)
    (top / "a").mkdir()
    (top / "a" / "Thumbs.db").write_text("x")
    here, made = os.getcwd(), [str(top / "chain")]
    os.mkdir(made[0])
    os.chdir(made[0])
    try:
        while len(made[-1]) < 4300:
            os.mkdir("d" * 200)
            os.chdir("d" * 200)
            made.append(made[-1] + "/" + "d" * 200)
        open("kept.txt", "w").close()
    finally:
        os.chdir(here)
    return str(top), made


def test_unreadable_folders_are_not_empty(spark, deep):
    top, chain = deep
    t = from_files(spark, top)
    rows = {r.path: r for r in t.collect()}
    assert len(rows) == t.count()
    lost = [p for p, r in rows.items() if r.error]
    assert lost and all(rows[p].is_dir and len(p) > 4000 for p in lost)
    plan = CLN.clean_plan(t, top, junk=True, empty_dirs=True)
    gone = {r.path for r in plan.where("action = 'rmdir'").collect()}
    assert gone == {top + "/empty", top + "/a"} and not gone & set(chain)


def test_a_root_that_cannot_be_read_is_a_row(spark, deep):
    lost = SF.list_tree(spark, deep[1][-1]).collect()
    assert [(r.path, bool(r.error)) for r in lost] == [(deep[1][-1], True)]
    assert SF.list_tree(spark, "/nowhere/at/all").count() == 0


def test_hashing_is_dealt_by_bytes(spark):
    sizes = [(f"/f{i:04d}", 10 if i % 50 else 5000) for i in range(2000)] + [("/none", None), ("/zero", 0)]
    df = spark.createDataFrame(sizes, "path string, size bigint").repartition(5, "path")
    rows = SF.byte_balanced(df, part_bytes=1000).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.path, r.size) for r in rows) == sorted(sizes)
    by = {}
    for r in rows:
        by.setdefault(r.p, []).append(r.size or 0)
    big = [v for v in by.values() if max(v) >= 1000]
    assert len(big) == 40 and all(len(v) == 1 for v in big)
    small = [sum(v) for v in by.values() if max(v) < 1000]
    assert max(small) <= 1010 and sum(x >= 900 for x in small) >= len(small) - 5
    assert SF.byte_balanced(df.limit(0)).count() == 0


def test_hashes_are_the_files_own(spark, tmp_path):
    import hashlib
    for i in range(30):
        (tmp_path / f"f{i}").write_bytes(b"x" * (i * 37 % 400))
    files = SF.list_files(spark, str(tmp_path))
    got = {r.path: r.md5 for r in SF.hash_paths(files, part_bytes=300).collect()}
    assert got == {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
