from filelake.operators import clean as CLN


def test_junk_default_and_protected(mk):
    m = mk([("/c/desktop.ini", "x"), ("/c/Thumbs.db", "x"), ("/c/.DS_Store", "x"), ("/c/document.txt", "x"),
            ("/c/photo.jpg", "x"), ("/c/.git/desktop.ini", "x"), ("/c/.github/x.tmp", "x")])
    got = {r.path for r in CLN.junk_plan(m, "/c").collect()}
    assert got == {"/c/desktop.ini", "/c/Thumbs.db", "/c/.DS_Store"}  # '.git' also guards '.github'


def test_junk_custom_pattern(mk):
    m = mk([("/c/test.log", "x"), ("/c/debug.log", "x"), ("/c/important.txt", "x")])
    assert CLN.junk_plan(m, "/c", ["*.log"]).count() == 2


def test_empty_dirs(mk, spark):
    files = mk([("/c/nonempty/file.txt", "x")])
    dirs = spark.createDataFrame([(p,) for p in ["/c", "/c/empty", "/c/nonempty", "/c/level1", "/c/level1/level2",
                                                 "/c/level1/level2/level3", "/c/.git", "/c/g", "/c/g/.git"]],
                                 "path string")
    got = {r.path for r in CLN.empty_dirs_plan(dirs, files, "/c").collect()}
    assert got == {"/c/empty", "/c/level1", "/c/level1/level2", "/c/level1/level2/level3"}


def test_empty_root_goes_and_passes_limit(mk, spark):
    files = spark.createDataFrame([], "path string, size bigint")
    chain = ["/c"] + ["/c/" + "/".join(f"d{i}" for i in range(k)) for k in range(1, 13)]
    dirs = spark.createDataFrame([(p,) for p in chain], "path string")
    got = {r.path for r in CLN.empty_dirs_plan(dirs, files, "/c", max_passes=10).collect()}
    assert len(got) == 10 and "/c" not in got  # only the 10 deepest go in 10 passes
    got3 = {r.path for r in CLN.empty_dirs_plan(dirs.limit(3), files, "/c").collect()}
    assert "/c" in got3


def test_permissions(spark):
    df = spark.createDataFrame([("/c/a", 0o644, False), ("/c/b", 0o600, False), ("/c/c", 0o700, False),
                                ("/c/d", 0o700, True), ("/c/e", 0o755, False)],
                               "path string, mode int, is_dir boolean")
    got = {r.path: r.new_mode for r in CLN.permission_plan(df).collect()}
    assert got == {"/c/b": 0o644, "/c/c": 0o755, "/c/d": 0o755}
    ntfs = CLN.permission_plan_ntfs(df).collect()
    assert len(ntfs) == 5 and all(r.new_uid == 1000 for r in ntfs)


def test_clean_plan_junk_before_empty_dirs(mk, spark):
    m = mk([("/c/only_junk/Thumbs.db", "x"), ("/c/keep/a.txt", "y")])
    dirs = spark.createDataFrame([("/c",), ("/c/only_junk",), ("/c/keep",)], "path string")
    plan = CLN.clean_plan(m, "/c", dirs=dirs, junk=True, empty_dirs=True)
    got = {(r.path, r.action) for r in plan.collect()}
    assert got == {("/c/only_junk/Thumbs.db", "delete"), ("/c/only_junk", "rmdir")}
    s = CLN.clean_summary(plan).first()
    assert (s.junk_deleted, s.dirs_removed) == (1, 1)


def test_ancestors_root_slash_and_nested(spark):
    from filelake.sources.manifest import ancestor_rows, directories_of
    df = spark.createDataFrame([("/a/b/c.txt",), ("/d.txt",)], "path string")
    assert {r.path for r in directories_of(df, "/").collect()} == {"/", "/a", "/a/b"}
    rows = {(r.anc, r.up) for r in ancestor_rows(df, "/drive").collect()}
    assert rows == set()  # nothing below /drive
    d2 = spark.createDataFrame([("/r/x/y",), ("/r",)], "path string")
    got = {(r.anc, r.up) for r in ancestor_rows(d2, "/r", include_self=True).collect()}
    assert got == {("/r", 2), ("/r/x", 1), ("/r/x/y", 0), ("/r", 0)}


def test_clean_plan_carries_modes_and_includes_folders(spark):
    m = spark.createDataFrame([("/c/a.txt", 5, 0o600, False), ("/c/d", 0, 0o700, True), ("/c/gone", 0, 0o700, True), ("/c/d/b.sh", 5, 0o755, False)],
                              "path string, size bigint, mode int, is_dir boolean")
    dirs = spark.createDataFrame([("/c/d", True), ("/c/gone", True)], "path string, is_dir boolean")
    plan = CLN.clean_plan(m, "/c", dirs=dirs)
    got = {(r.path, r.action): r.new_mode for r in plan.collect()}
    assert got == {("/c/a.txt", "chmod"): 0o644, ("/c/d", "chmod"): 0o755, ("/c/gone", "rmdir"): None}
    from filelake.plans.apply import apply_plan
    after = {r.path: r.mode for r in apply_plan(m, plan).collect()}
    assert after == {"/c/a.txt": 0o644, "/c/d": 0o755, "/c/d/b.sh": 0o755}


def test_clean_plan_without_modes(spark):
    m = spark.createDataFrame([("/c/Thumbs.db", 5), ("/c/a.txt", 5)], "path string, size bigint")
    assert {(r.path, r.action) for r in CLN.clean_plan(m, "/c").collect()} == {("/c/Thumbs.db", "delete")}
