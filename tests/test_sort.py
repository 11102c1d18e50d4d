from filelake.operators import classify as CL
from filelake.operators import sort as SO


def _files(mk, names, root="/r"):
    return mk([(f"{root}/{n}", "x" * 10) for n in names])


def _detect(mk, names):
    return CL.detect_type(CL.sort_files(_files(mk, names), "/r")).first().detected_type


def test_detect(mk, spark):
    assert _detect(mk, ["a.pdf", "b.docx", "c.txt"]) == "documents"
    assert _detect(mk, ["a.mp3", "b.flac", "c.wav"]) == "music"
    assert _detect(mk, ["a.jpg", "b.png", "c.gif"]) == "pictures"
    assert _detect(mk, ["a.mp4", "b.mkv", "c.avi"]) == "videos"
    assert _detect(mk, ["a.pdf", "b.mp3", "c.jpg", "d.mp4"]) == "mixed"
    empty = spark.createDataFrame([], "path string, size bigint, md5 string")
    assert CL.detect_type(CL.sort_files(empty, "/r")).first().detected_type == "mixed"


def test_collision_numbering(mk):
    plan = SO.sort_plan(_files(mk, ["test.pdf", "subfolder/test.pdf"]), "/r", "documents")
    assert sorted(r.dest for r in plan.collect()) == ["/r/_Unclassified/test.pdf", "/r/_Unclassified/test_1.pdf"]


def test_existing_name_is_taken(mk):
    plan = SO.sort_plan(_files(mk, ["a/x.pdf", "Documents/x.pdf", "Documents/x_1.pdf"]), "/r", "mixed")
    got = {r.path: (r.action, r.dest) for r in plan.collect()}
    assert got["/r/a/x.pdf"] == ("move", "/r/Documents/x_2.pdf")
    assert got["/r/Documents/x.pdf"] == ("skip", "/r/Documents/x.pdf")


def test_document_folders(mk):
    c = CL.classify(_files(mk, ["SOFITEL/doc.pdf", "Desktop/doc.pdf", "zips/a.pdf", "_from_2019/b.pdf",
                                 "other/c.pdf", "d.pdf", "other/noext", "other/e.mp3"]), "/r", "documents")
    got = {r.path: r.category for r in c.collect()}
    assert got == {"/r/SOFITEL/doc.pdf": "05_Professionnel", "/r/Desktop/doc.pdf": "07_Personnel",
                   "/r/zips/a.pdf": "06_Ressources_et_Documentation", "/r/_from_2019/b.pdf": "07_Personnel",
                   "/r/other/c.pdf": "_Unclassified", "/r/d.pdf": "_Unclassified",
                   "/r/other/noext": "_Unclassified"}


def test_pictures_year(mk, spark):
    m = mk([("/r/20240115_123456.jpg", "x", None), ("/r/IMG_20240115_123456.jpg", "x", None),
            ("/r/trip 2019-07-01.png", "x", None), ("/r/19850101.jpg", "x", None),
            ("/r/exif.jpg", "x", "2012:03:04 10:00:00"), ("/r/zero 2001_01_01.jpg", "x", "0000:01:01"),
            ("/r/logo.svg", "x", None), ("/r/notes.txt", "x", None)], "exif_date string")
    got = {r.path: r.category for r in CL.classify(m, "/r", "pictures").collect()}
    assert got == {"/r/20240115_123456.jpg": "2024", "/r/IMG_20240115_123456.jpg": "2024",
                   "/r/trip 2019-07-01.png": "2019", "/r/19850101.jpg": "_Undated",
                   "/r/exif.jpg": "2012", "/r/zero 2001_01_01.jpg": "2001", "/r/logo.svg": "_Design"}


def test_videos(mk):
    c = CL.classify(_files(mk, ["N_20240115_123456.mp4", "_from_MOVIE/movie.mp4", "_from_sent/v.mov",
                                "_from_whatsapp video/w.mp4", "x/y.mkv"]), "/r", "videos")
    got = {r.path: r.category for r in c.collect()}
    assert got["/r/N_20240115_123456.mp4"] == "Dashcam"
    assert got["/r/_from_MOVIE/movie.mp4"] == "Films"
    assert got["/r/_from_sent/v.mov"] == "Famille"
    assert got["/r/_from_whatsapp video/w.mp4"] == "WhatsApp Video"
    assert got["/r/x/y.mkv"] == "_Misc"


def test_music(mk):
    m = mk([("/r/a/s.mp3", "x", "AC/DC"), ("/r/_from_home videos/t.flac", "x", None),
            ("/r/b/u.ogg", "x", ""), ("/r/c/v.txt", "x", "X")], "artist string")
    got = {r.path: r.category for r in CL.classify(m, "/r", "music").collect()}
    assert got == {"/r/a/s.mp3": "AC_DC", "/r/_from_home videos/t.flac": "_Various/Home Videos",
                   "/r/b/u.ogg": "_Unknown"}


def test_summary(mk):
    plan = SO.sort_plan(_files(mk, ["a.pdf", "b.mp3", "c/d.pdf"]), "/r", "auto")
    s = SO.sort_summary(plan).first()
    assert (s.total_files, s.moved_count, s.skipped_count, s.space_organized) == (3, 3, 0, 30)
    assert {r.category: r.files for r in SO.by_category(plan).collect()} == {"Documents": 2, "Music": 1}
