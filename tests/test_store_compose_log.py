import random
import threading

import pytest
from pyspark.sql import functions as F

from filelake.operators import clean as CLN
from filelake.operators import dedup as D
from filelake.operators import rename as RN
from filelake.operators import sort as SO
from filelake.plans import oplog as OL
from filelake.plans.apply import apply_plan, verify_plan
from filelake.plans.commitlog import CommitLog, ConflictError, latest
from filelake.plans.compose import compose, compose_in_place
from filelake.sources.store import ManifestStore

COLUMNS = "path string, size bigint, md5 string, mode int, uid int, gid int, content binary"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def lake(spark):
    rows = [(f"/r/{'abc'[i % 3]}/f{i % 40}{' (1)' if i % 5 == 0 else ''}.{('pdf', 'mp3', 'tmp')[i % 3]}", i % 7, f"h{i % 9}" if i % 11 else None,
             0o600 + i % 2, i % 2, None, bytes(i % 7)) for i in range(120)]
    return spark.createDataFrame(sorted({r[0]: r for r in rows}.values()), COLUMNS)


# --- apply, verify -----------------------------------------------------------------


def test_owners_and_modes_are_applied(lake):
    plan = CLN.clean_plan(lake, "/r", uid=7, gid=8)
    after = apply_plan(lake, plan)
    kept = {r.path for r in lake.collect()} - {r.path for r in plan.where("action = 'delete'").collect()}
    got = {r.path: (r.mode, r.uid, r.gid) for r in after.collect()}
    assert set(got) == kept and all(v[0] & 0o644 == 0o644 and v[1:] == (7, 8) for v in got.values())
    one = CLN.with_permissions(CLN.without_junk(lake, "/r"), "/r", 7, 8)
    assert rows_of(one) == rows_of(after)
    assert apply_plan(lake, CLN.clean_plan(lake, "/r", uid=7, gid=8)).where("gid is null").isEmpty()


def test_a_root_with_a_slash_keeps_its_own_folder(spark):
    m = spark.createDataFrame([("/t", None, True, 0o700), ("/t/a.txt", 3, False, 0o600)], "path string, size bigint, is_dir boolean, mode int")
    plans = [rows_of(CLN.clean_plan(m, r)) for r in ("/t", "/t/")]
    assert plans[0] == plans[1] and ("/t", "chmod") in {(r[0], r[1]) for r in plans[1]}


def test_rename_onto_a_new_file_is_found(mk, spark):
    m = mk([("/r/x (1).txt", "1"), ("/r/y - Copy.txt", "2")])
    plan = RN.rename_plan(m, "/r")
    cur = spark.createDataFrame([("/r/x (1).txt", 1), ("/r/x.txt", 9), ("/r/y - Copy.txt", 1)], "path string, size bigint")
    assert {r.path: r.status for r in verify_plan(plan, cur).collect()} == {"/r/x (1).txt": "dest_exists", "/r/y - Copy.txt": "ok"}


def test_verify_rows_without_a_size(spark):
    plan = spark.createDataFrame([("/r/d", "rmdir"), ("/r/gone", "rmdir"), ("/r/a", "chmod")], "path string, action string")
    cur = spark.createDataFrame([("/r/d", None), ("/r/a", 4)], "path string, size bigint")
    got = verify_plan(plan, cur)
    assert got.columns == ["path", "action", "status"]
    assert {r.path: r.status for r in got.collect()} == {"/r/d": "ok", "/r/gone": "already_gone", "/r/a": "ok"}


# --- store ---------------------------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def moved_columns(df):
    """Columns that pass through each shuffle of the plan."""
    import re
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.findall(r"(\w+)#\d+", x) for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)]


def test_plans_meet_a_stored_manifest_without_moving_it(lake, spark, tmp_path, no_broadcast):
    store = ManifestStore.create(lake, str(tmp_path / "m"), buckets=8)
    plan = spark.createDataFrame([("/r/a/f0.pdf", "delete", None, "/r/b/f1.mp3", 1)], "path string, action string, dest string, keeper_path string, size bigint")
    for df in (store.apply(plan), store.verify(plan), *store.advanced(plan)):
        moved = moved_columns(df)
        assert moved and not any({"content", "md5", "mode"} & set(c) for c in moved), moved
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_versions_of_a_store(lake, spark, tmp_path, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        place = str(tmp_path / "m")
        v0 = ManifestStore.create(lake, place, buckets=4)
        clean = CLN.clean_plan(lake, "/r", uid=3)
        v1 = v0.advance(clean)
        m1 = apply_plan(lake, clean)
        assert rows_of(v1.plain()) == rows_of(m1) == rows_of(v1.keyed())
        sort = SO.sort_plan(v1.plain(), "/r", "mixed")
        again = ManifestStore.open(spark, place, 1)
        again.forget()
        v2 = again.advance(sort)
        want = rows_of(apply_plan(m1, sort))
        assert rows_of(v2.plain()) == want
        # each row lies in the bucket of its new path: a join by bucket finds all
        assert v2.keyed().join(v2.plain().select("path").repartition(4, "path").hint("merge"), "path").count() == len(want)
        assert rows_of(ManifestStore.open(spark, place, 2).keyed()) == want and rows_of(v0.plain()) == rows_of(lake)
        dedup = D.dedup_plan(v2.plain(), "/r", min_size=1)
        assert rows_of(v2.verify(dedup)) == rows_of(verify_plan(dedup, v2.plain()))
    finally:
        spark.conf.set(key, old)


def test_an_empty_manifest_is_stored(lake, spark, tmp_path):
    store = ManifestStore.create(lake.limit(0), str(tmp_path / "m"))
    assert store.advance(spark.createDataFrame([], "path string, action string, dest string")).plain().count() == 0


# --- plan algebra ------------------------------------------------------------------------


def random_plan(rnd, paths, taken):
    """A plan for the given paths, with destinations that are free."""
    rows = []
    free = [f"/r/n{k}" for k in range(60)]
    rnd.shuffle(free)
    left = set(paths)
    for p in sorted(paths):
        kind = rnd.choice(["keep", "skip", "delete", "delete_duplicate", "move", "rename", "chmod", "none", "none"])
        if kind == "none":
            continue
        dest = None
        if kind in ("move", "rename"):
            # a place that is free, maybe one that an earlier step left
            options = [f for f in free if f not in left and f not in taken]
            dest = rnd.choice(options) if options else None
            if dest is None:
                continue
            taken.add(dest)
        rows.append((p, kind, dest, rnd.choice([None, 0o644, 0o755]) if kind in ("move", "chmod") else None,
                     rnd.choice([None, 5]) if kind == "chmod" else None, None))
    return rows


PLAN = "path string, action string, dest string, new_mode int, new_uid int, new_gid int"


@pytest.mark.parametrize("seed", range(6))
def test_composed_plans_equal_plans_one_by_one(spark, seed):
    rnd = random.Random(seed)
    m = spark.createDataFrame([(f"/r/n{k}", k, f"h{k}", 0o600, 1, 1, b"") for k in range(25)], COLUMNS)
    now, plans = m, []
    for _ in range(3):
        rows = random_plan(rnd, [r.path for r in now.select("path").collect()], set())
        plan = spark.createDataFrame(rows, PLAN)
        plans.append(plan)
        now = spark.createDataFrame(apply_plan(now, plan).collect(), COLUMNS)
    one = compose(*plans)
    assert one.count() == one.select("path").distinct().count()
    assert rows_of(apply_plan(m, one)) == rows_of(now)
    assert rows_of(apply_plan(m, compose(compose(plans[0], plans[1]), plans[2]))) == rows_of(apply_plan(m, compose(plans[0], compose(plans[1], plans[2]))))


@pytest.mark.parametrize("seed", range(4))
def test_plans_that_move_nothing_are_composed_by_one_aggregation(spark, seed):
    rnd = random.Random(50 + seed)
    m = spark.createDataFrame([(f"/r/n{k}", k, f"h{k}", 0o600, 1, 1, b"") for k in range(25)], COLUMNS)
    now, plans = m, []
    for step in range(3):
        rows = random_plan(rnd, [r.path for r in now.select("path").collect()], set())
        plan = spark.createDataFrame([r for r in rows if step == 2 or r[1] not in ("move", "rename")], PLAN)
        plans.append(plan.withColumn("reason", F.lit(f"step {step}")))
        now = spark.createDataFrame(apply_plan(now, plan).collect(), COLUMNS)
    one = compose_in_place(*plans)
    assert rows_of(apply_plan(m, one)) == rows_of(now)
    key = ["path", "action", "dest", "new_mode", "new_uid", "new_gid", "reason"]
    assert rows_of(one.select(*key)) == rows_of(compose(*plans).select(*key))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_composition_of_each_kind(spark):
    def plan(*rows):
        return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], PLAN)
    a = plan(("/a", "move", "/b"), ("/c", "chmod", None, 0o644), ("/d", "delete"), ("/e", "rename", "/f", 0o755), ("/g", "move", "/h"))
    b = plan(("/b", "delete"), ("/c", "move", "/d"), ("/f", "move", "/e"), ("/h", "chmod", None, 0o700, 9), ("/i", "rmdir"), ("/j", "keep"))
    got = {r.path: (r.action, r.dest, r.new_mode, r.new_uid) for r in compose(a, b).collect()}
    assert got == {"/a": ("delete", None, None, None), "/c": ("move", "/d", 0o644, None), "/d": ("delete", None, None, None),
                   "/e": ("chmod", None, 0o755, None), "/g": ("move", "/h", 0o700, 9), "/i": ("rmdir", None, None, None)}


# --- commit log -----------------------------------------------------------------------------


def ops(spark, *rows):
    plan = spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], PLAN)
    return OL.op_log_from_plan(plan)


def test_commits_checkpoints_and_recovery(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.version() == 0 and log.read().count() == 0 and log.checkpoint() == 0
    assert log.append(ops(spark, ("/a", "delete"), ("/b", "chmod", None, 0o755, 4), ("/c", "move", "/d"))) == 1
    todo = log.recover()
    assert log.append(OL.op_log_update(todo.where("source = '/a'"), "done", 0)) == 2
    assert log.append(OL.op_log_update(todo.where("source = '/b'"), "failed", 0)) == 3
    before = rows_of(log.recover().drop("ts"))
    assert log.checkpoint() == 3 and log.checkpoint() == 3
    assert log.read().count() == 3  # superseded rows are folded
    assert rows_of(log.recover().drop("ts")) == before
    plan = {r.path: r for r in OL.plan_from_log(log.recover()).collect()}
    assert set(plan) == {"/b", "/c"} and (plan["/b"].new_mode, plan["/b"].new_uid, plan["/c"].dest) == (0o755, 4, "/d")
    log.append(OL.op_log_update(todo.where("source = '/b'"), "done", 0))
    assert [r.source for r in log.recover().collect()] == ["/c"]
    assert len(log.vacuum()) == 3 and [r.source for r in log.recover().collect()] == ["/c"]
    with pytest.raises(ConflictError):
        log.append(ops(spark, ("/z", "delete")), expect=2)
    assert log.append(ops(spark, ("/z", "delete")), expect=4) == 5 and log.recover().count() == 2


def test_racing_writers_lose_nothing(spark, tmp_path):
    place = str(tmp_path / "log")
    numbers, errors = [], []

    def write(w):
        try:
            log = CommitLog(spark, place)
            for k in range(4):
                numbers.append(log.append(ops(spark, (f"/w{w}/{k}", "delete"))))
                if k == 2:
                    log.checkpoint()
        except Exception as e:  # noqa: BLE001 - shown by the assert
            errors.append(e)
    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted(numbers) == list(range(1, 17))
    assert {r.source for r in CommitLog(spark, place).recover().collect()} == {f"/w{w}/{k}" for w in range(4) for k in range(4)}


def test_readers_see_whole_commits_only(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.append(ops(spark, ("/a", "delete")))
    ops(spark, ("/b", "delete")).write.parquet(f"{log.location}/data/left-by-a-dead-writer")
    assert [r.source for r in log.recover().collect()] == ["/a"]
    assert log.vacuum() == ["left-by-a-dead-writer"]


def test_latest_is_by_commit_before_seq(spark):
    rows = spark.createDataFrame([("x", "pending", 9, 1), ("x", "done", 0, 2)], "op_id string, status string, seq bigint, commit bigint").withColumn("ts", F.current_timestamp())
    assert latest(rows).first().status == "done"
