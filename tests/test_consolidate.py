import pytest

from filelake.operators import consolidate as CO

BIG = "x" * 150


def test_duplicate_and_unique(mk):
    m = mk([("/b/target/organized.txt", "same " + BIG), ("/b/source/duplicate.txt", "same " + BIG),
            ("/b/source/unique.txt", "other " + BIG)])
    got = {r.path: (r.action, r.dest) for r in CO.consolidate_plan(m, "/b", "/b/target").collect()}
    assert got == {"/b/source/duplicate.txt": ("delete", None),
                   "/b/source/unique.txt": ("move", "/b/target/_STAGING/_from_source/unique.txt")}


def test_presets_and_min_size(mk):
    m = mk([("/b/s/doc.txt", BIG), ("/b/s/doc.pdf", BIG + "1"), ("/b/s/photo.jpg", BIG + "2"),
            ("/b/s/music.mp3", BIG + "3"), ("/b/s/tiny.txt", "x")])
    assert CO.consolidate_plan(m, "/b", "/b/t", file_type="documents").count() == 2
    assert CO.consolidate_plan(m, "/b", "/b/t", file_type="nope").count() == 0


def test_staging_names(mk):
    m = mk([("/b/root.txt", BIG), ("/b/subdir/file.txt", BIG + "1"), ("/b/x/data/f.txt", BIG + "2")])
    got = {r.path: r.dest for r in CO.consolidate_plan(m, "/b", "/b/t").collect()}
    assert got == {"/b/root.txt": "/b/t/_STAGING/_from_root/root.txt",
                   "/b/subdir/file.txt": "/b/t/_STAGING/_from_subdir/file.txt",
                   "/b/x/data/f.txt": "/b/t/_STAGING/_from_x_data/f.txt"}


def test_collision_with_existing_and_between_movers(mk):
    m = mk([("/b/t/_STAGING/_from_root/collision_test.txt", "old " + BIG),
            ("/b/collision_test.txt", "new " + BIG),
            ("/b/p/a.txt", "one " + BIG), ("/b/q/p/a.txt", "two " + BIG)])
    got = {r.path: r.dest for r in CO.consolidate_plan(m, "/b", "/b/t").collect()}
    assert got["/b/collision_test.txt"] == "/b/t/_STAGING/_from_root/collision_test_1.txt"
    assert {got["/b/p/a.txt"], got["/b/q/p/a.txt"]} == {"/b/t/_STAGING/_from_p/a.txt", "/b/t/_STAGING/_from_p/a_1.txt"}


def test_staging_in_target_is_outside(mk):
    m = mk([("/b/t/_STAGING/old/f.txt", BIG), ("/b/T/g.txt", "z" + BIG)])
    got = {r.path: r.action for r in CO.consolidate_plan(m, "/b", "/b/t").collect()}
    assert got == {"/b/t/_STAGING/old/f.txt": "move"}  # '/b/T' is in target (case-insensitive)


def test_same_source_and_target_rejected(mk):
    with pytest.raises(ValueError):
        CO.consolidate_plan(mk([("/b/a.txt", BIG)]), "/b", "/b/")


def test_target_outside_source(mk):
    src = mk([("/src/a/dup.txt", "same " + BIG), ("/src/a/new.txt", "fresh " + BIG)])
    tgt = mk([("/tgt/old/dup.txt", "same " + BIG)])
    got = {r.path: (r.action, r.dest) for r in CO.consolidate_plan(src, "/src", "/tgt", target_manifest=tgt).collect()}
    assert got == {"/src/a/dup.txt": ("delete", None), "/src/a/new.txt": ("move", "/tgt/_STAGING/_from_a/new.txt")}


def test_target_outside_source_summary(mk):
    src = mk([("/src/a/dup.txt", "same " + BIG), ("/src/a/new.txt", "fresh " + BIG)])
    tgt = mk([("/tgt/old/dup.txt", "same " + BIG)])
    s = CO.consolidate_summary(src, "/src", "/tgt", target_manifest=tgt).first()
    assert (s.files_moved, s.files_deleted, s.already_in_target) == (1, 1, 1)
