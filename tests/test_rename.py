from filelake.operators import rename as RN


def _plan(mk, rows):
    return {r.path: (r.action, r.dest) for r in RN.rename_plan(mk(rows), "/r").collect()}


def test_patterns(mk):
    m = mk([(f"/r/{n}", "x") for n in ["file (1).txt", "file (10).png", "file - Copy.txt", "file - Copie (2).txt",
                                       "file.txt", "file_1.txt", "file-copy.txt"]])
    got = {r.name: (r.pattern, r.clean_name) for r in RN.rename_candidates(m, "/r").collect()}
    assert got == {"file (1).txt": ("(N)", "file.txt"), "file (10).png": ("(N)", "file.png"),
                   "file - Copy.txt": ("- Copy", "file.txt"), "file - Copie (2).txt": ("(N)", "file - Copie.txt")}


def test_actions(mk):
    got = _plan(mk, [("/r/a (1).txt", "A"), ("/r/b.txt", "B"), ("/r/b (1).txt", "B"),
                     ("/r/c.txt", "C"), ("/r/c - Copy.txt", "other")])
    assert got == {"/r/a (1).txt": ("rename", "/r/a.txt"), "/r/b (1).txt": ("delete_duplicate", None),
                   "/r/c - Copy.txt": ("collision_rename", "/r/c_1.txt")}


def test_null_hash_skips(spark):
    df = spark.createDataFrame([("/r/f.txt", 1, None), ("/r/f (1).txt", 1, "abc")], "path string, size bigint, md5 string")
    assert {r.path: r.action for r in RN.rename_plan(df, "/r").collect()} == {"/r/f (1).txt": "skip"}


def test_mixed(mk):
    got = _plan(mk, [("/r/file.txt", "orig"), ("/r/file (1).txt", "orig"), ("/r/file (2).txt", "diff"),
                     ("/r/doc - Copy.txt", "d"), ("/r/normal.txt", "n")])
    acts = sorted(a for a, _ in got.values())
    assert acts == ["collision_rename", "delete_duplicate", "rename"]


def test_no_original_order(mk):
    got = _plan(mk, [("/r/x (1).txt", "A"), ("/r/x (2).txt", "A"), ("/r/x - Copy.txt", "B"), ("/r/x (3).txt", "C")])
    # descending stems: 'x - Copy' > 'x (3)' > 'x (2)' > 'x (1)'; the first takes the name
    assert got["/r/x - Copy.txt"] == ("rename", "/r/x.txt")
    assert got["/r/x (3).txt"] == ("collision_rename", "/r/x_1.txt")
    assert got["/r/x (2).txt"] == ("collision_rename", "/r/x_2.txt")
    assert got["/r/x (1).txt"] == ("collision_rename", "/r/x_3.txt")


def test_self_match_is_skipped_not_deleted(mk):
    assert _plan(mk, [("/r/archive (1).tar.gz", "only copy")]) == {"/r/archive (1).tar.gz": ("skip", None)}


def test_protected_dirs(mk):
    got = _plan(mk, [("/r/DevOps/a (1).txt", "x"), ("/r/ok/a (1).txt", "x")])
    assert list(got) == ["/r/ok/a (1).txt"]


def test_summary(mk):
    plan = RN.rename_plan(mk([("/r/b.txt", "B"), ("/r/b (1).txt", "B"), ("/r/q (1).txt", "Q")]), "/r")
    s = RN.rename_summary(plan).first()
    assert (s.total_scanned, s.renamed, s.duplicates_deleted, s.skipped, s.space_freed) == (2, 1, 1, 0, 1)
