from pyspark.sql import functions as F

from filelake.operators.collide import assign_slots


def _movers(spark, n):
    return (spark.createDataFrame([(f"/src/{i:03d}/x.txt",) for i in range(n)], "path string")
                 .withColumn("dir", F.lit("/dst")).withColumn("name", F.lit("x.txt")))


def _slot(dest):
    name = dest.rsplit("/", 1)[1]
    return 0 if name == "x.txt" else int(name[2:-4])


def test_path_order_and_taken(spark):
    existing = spark.createDataFrame([("/dst", "x_2.txt"), ("/dst", "other.txt")], "dir string, name string")
    out = {r.path: _slot(r.dest) for r in assign_slots(_movers(spark, 6), "dir", "name", existing).collect()}
    assert [out[f"/src/{i:03d}/x.txt"] for i in range(6)] == [0, 1, 3, 4, 5, 6]


def test_hot_group_is_split_but_slots_stay_dense(spark):
    existing = spark.createDataFrame([("/dst", "x_2.txt")], "dir string, name string")
    out = assign_slots(_movers(spark, 50), "dir", "name", existing, hot_rows=7).collect()
    slots = sorted(_slot(r.dest) for r in out)
    assert slots == [s for s in range(51) if s != 2]
    whole = assign_slots(_movers(spark, 50), "dir", "name", existing).collect()
    assert {r.path: r.dest for r in out} == {r.path: r.dest for r in whole}


def test_split_keeps_a_descending_order_and_the_other_groups(spark):
    movers = _movers(spark, 30).unionByName(_movers(spark, 3).withColumn("dir", F.lit("/other")).withColumn("path", F.concat(F.lit("/o"), "path")))
    existing = spark.createDataFrame([("/dst", "x_1.txt"), ("/other", "x.txt")], "dir string, name string")
    order = [F.col("path").desc()]
    cut = assign_slots(movers, "dir", "name", existing, order, hot_rows=4).collect()
    whole = assign_slots(movers, "dir", "name", existing, order).collect()
    assert {r.path: r.dest for r in cut} == {r.path: r.dest for r in whole} and len(cut) == 33


def test_mover_bare_name_blocks_slot_of_other_group(spark):
    movers = spark.createDataFrame([("/a/x.txt", "/d", "x.txt"), ("/b/x.txt", "/d", "x.txt"),
                                    ("/c/x_1.txt", "/d", "x_1.txt")], "path string, dir string, name string")
    empty = spark.createDataFrame([], "dir string, name string")
    dests = {r.path: r.dest for r in assign_slots(movers, "dir", "name", empty).collect()}
    assert dests == {"/a/x.txt": "/d/x.txt", "/b/x.txt": "/d/x_2.txt", "/c/x_1.txt": "/d/x_1.txt"}


def test_scattered_taken_slots_match_brute_force(spark):
    taken = [0, 1, 2, 5, 7, 8, 11, 13, 17, 40, 1000]
    existing = spark.createDataFrame([("/dst", "x.txt" if k == 0 else f"x_{k}.txt") for k in taken], "dir string, name string")
    free = [s for s in range(60) if s not in taken][:30]
    for hot_rows in (1_000_000, 5):
        out = assign_slots(_movers(spark, 30), "dir", "name", existing, hot_rows=hot_rows).orderBy("path").collect()
        assert [_slot(r.dest) for r in out] == free


def test_taken_slots_travel_as_rows(spark):
    existing = spark.createDataFrame([("/dst", f"x_{k}.txt") for k in range(1, 40, 2)], "dir string, name string")
    out = assign_slots(_movers(spark, 4), "dir", "name", existing)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in text and text.count("hashpartitioning(_d") == 1  # one shuffle by group
    assert sorted(_slot(r.dest) for r in out.collect()) == [0, 2, 4, 6]
