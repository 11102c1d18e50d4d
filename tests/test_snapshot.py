import json

from filelake.operators import snapshot as S
from filelake.sources.snapshot_io import diff_record, read_snapshot, write_snapshot


def _snap(mk, rows, root="/s", **kw):
    return S.snapshot(mk(rows), root, **kw)


def test_extensions(mk):
    s = _snap(mk, [("/s/file1.txt", "a"), ("/s/file2.txt", "b"), ("/s/file3.jpg", "c"), ("/s/file4.pdf", "d")])
    assert {r.ext: r["count"] for r in s.by_extension.collect()} == {".txt": 2, ".jpg": 1, ".pdf": 1}


def test_top_dirs_subtree_inclusive(mk):
    s = _snap(mk, [("/s/Documents/file1.txt", "a"), ("/s/Documents/file2.txt", "b"),
                   ("/s/Documents/nested/file3.txt", "c"), ("/s/Pictures/photo1.jpg", "d"), ("/s/root.txt", "e")])
    assert {r.top: r.file_count for r in s.top_dirs.collect()} == {"Documents": 3, "Pictures": 1}


def test_empty_top_dir_has_zeros(mk, spark):
    dirs = spark.createDataFrame([("/s/Empty",), ("/s/A",)], "path string")
    s = _snap(mk, [("/s/A/x.txt", "abc")], dirs=dirs)
    assert {r.top: (r.size_bytes, r.file_count) for r in s.top_dirs.collect()} == {"A": (3, 1), "Empty": (0, 0)}


def test_largest_order(mk):
    s = _snap(mk, [("/s/small.txt", "x"), ("/s/medium.txt", "x" * 100), ("/s/large.txt", "x" * 1000),
                   ("/s/huge.txt", "x" * 10000)])
    rows = s.largest.orderBy("rank").collect()
    assert rows[0].path == "/s/huge.txt" and rows[-1].path == "/s/small.txt"


def test_no_extension_and_samples(mk):
    s = _snap(mk, [("/s/README", "a"), ("/s/Makefile", "b")] + [(f"/s/f{i}.txt", "x") for i in range(10)])
    assert {r.ext: r["count"] for r in s.by_extension.collect()} == {"": 2, ".txt": 10}
    assert s.samples.filter("ext = '.txt'").count() == 3


def test_skip_dirs_and_total_dirs(mk):
    s = _snap(mk, [("/s/a/x.txt", "1"), ("/s/node_modules/p/y.txt", "2"), ("/s/.git/z", "3")])
    r = s.summary.first()
    assert r.total_files == 1
    assert r.total_dirs == 4  # a, node_modules, node_modules/p, .git: skip list not applied


def test_diff_new_extension(mk):
    before = _snap(mk, [("/s/file1.txt", "a")])
    after = _snap(mk, [("/s/file1.txt", "a"), ("/s/file2.pdf", "bb")])
    d = S.snapshot_diff(after, before).first()
    assert d.new_extension_counts == {".pdf": 1}
    assert (d.files_added, d.files_removed, d.size_change_bytes) == (1, 0, 2)
    assert d.summary == "+1 files, 1 new extensions, 2.0 B change"
    same = S.snapshot_diff(before, before).first()
    assert same.summary == "No changes"


def test_json_round_trip(mk, spark, tmp_path):
    s = _snap(mk, [("/s/a.txt", "abc"), ("/s/D/b.jpg", "hello")])
    out = str(tmp_path / "snap")
    write_snapshot(s.record(), out)
    back = read_snapshot(spark, out).first()
    assert back.summary.total_files == 2
    assert back.by_extension[".jpg"]["sample_paths"] == ["/s/D/b.jpg"]
    assert not back.is_diff
    diff_doc = tmp_path / "diff.json"
    diff_doc.write_text(json.dumps({"path": "/s", "files_added": 3, "new_extensions": {".x": 1}}))
    d = read_snapshot(spark, str(diff_doc)).first()
    assert d.is_diff and d.files_added == 3


def test_diff_json_round_trip_and_quick(mk, spark, tmp_path):
    before = _snap(mk, [("/s/file1.txt", "a")])
    after = _snap(mk, [("/s/file1.txt", "a"), ("/s/file2.pdf", "bb")], quick=True)
    assert after.largest is None
    assert after.record().first().largest_files == []
    out = str(tmp_path / "diff")
    write_snapshot(diff_record(S.snapshot_diff(after, before), "/s"), out)
    d = read_snapshot(spark, out).first()
    assert d.is_diff and d.files_added == 1 and d.new_extensions == {".pdf": 1}


def test_diff_against_a_stored_snapshot(spark, mk, tmp_path):
    from filelake.sources.snapshot_io import snapshot_from_record
    before = _snap(mk, [("/s/a.txt", "x"), ("/s/b.old", "yy")])
    after = _snap(mk, [("/s/a.txt", "x"), ("/s/c.new", "zzz"), ("/s/d/e.new", "z")])
    write_snapshot(before.record(), str(tmp_path / "before"))
    stored = read_snapshot(spark, str(tmp_path / "before"))
    d = S.snapshot_diff(after, snapshot_from_record(stored, "/s"))
    assert d.collect() == S.snapshot_diff(after, before).collect()
    assert d.first().new_extension_counts == {".new": 2} and d.first().removed_extensions == 1
    doc = diff_record(d, "/s", after.record(), stored)
    write_snapshot(doc, str(tmp_path / "diff"))
    r = read_snapshot(spark, str(tmp_path / "diff")).first()
    assert r.is_diff and r.summary_text == d.first().summary
    kept = json.loads(r.document)
    assert kept["previous_timestamp"] == stored.first().timestamp and kept["current_timestamp"]
    assert kept["new_extensions"] == {".new": 2}


def test_sharded_snapshot_round_trip_and_document(mk, spark, tmp_path):
    import json

    from filelake.sources import snapshot_io as IO
    m = mk([(f"/s/d{i % 7}/f{i}.x{i % 25}", "y" * i) for i in range(200)] + [("/s/r.txt", "a"), ("/s/q", "")])
    snap = S.snapshot(m, "/s")
    at = str(tmp_path / "snap")
    IO.write_sharded(snap, at)
    back = IO.read_sharded(spark, at)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for facet in ("summary", "by_extension", "top_dirs", "largest"):
        assert rows(getattr(back, facet)) == rows(getattr(snap, facet)), facet
    assert rows(back.samples.select("ext", "path", "sample_rank")) == rows(snap.samples.select("ext", "path", "sample_rank"))
    doc = json.loads("".join(IO.document_lines(spark, at)))
    want = snap.record().first().asDict(recursive=True)
    assert {k: v for k, v in doc.items() if k != "timestamp"} == {k: v for k, v in want.items() if k != "timestamp"}
    assert len(spark.read.json(f"{at}/by_extension").inputFiles()) > 1
    later = S.snapshot(m.filter("size > 10"), "/s")
    diff, changes = S.snapshot_diff(later, back, with_map=False), S.ext_changes(later, back)
    assert "collect_list" not in diff._jdf.queryExecution().optimizedPlan().toString() and "new_extension_counts" not in diff.columns
    IO.write_sharded_diff(diff, changes, str(tmp_path / "diff"))
    head, rows_of_it = IO.read_sharded_diff(spark, str(tmp_path / "diff"))
    assert rows(rows_of_it) == rows(changes) and head.first().summary == diff.first().summary
    quick = S.snapshot(m, "/s", quick=True)
    IO.write_sharded(quick, str(tmp_path / "quick"))
    assert json.loads("".join(IO.document_lines(spark, str(tmp_path / "quick"))))["largest_files"] == []
