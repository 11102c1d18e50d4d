import fnmatch
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.functions.fmt import size_text, size_text_2, size_text_signed
from filelake.functions.globs import globs_regex


def _py_suffix(name):
    i = name.rfind(".")
    return name[i:] if 0 < i < len(name) - 1 else ""


def test_ext_stem_name(spark):
    names = ["a.tar.gz", ".bashrc", "f.", "README", "Photo.JPG", "x (1).txt", "..."]
    df = spark.createDataFrame([("/r/d/" + n,) for n in names], "path string")
    out = df.select(P.name_of("path").alias("n"), P.ext_of(P.name_of("path")).alias("e"),
                    P.stem_of(P.name_of("path")).alias("s")).collect()
    for r, n in zip(out, names):
        assert r.n == n
        assert r.e == _py_suffix(n).lower()
        assert r.s == n[: len(n) - len(_py_suffix(n))]


def test_relative_parts(spark):
    df = spark.createDataFrame([("/drive/a.txt",), ("/drive/D/x/b.txt",), ("/other/c.txt",)], "path string")
    r = df.select(P.rel_parent("path", "/drive").alias("rp"), P.top_of("path", "/drive").alias("top"),
                  P.depth_of("path").alias("d")).collect()
    assert [x.rp for x in r] == ["", "D/x", None]
    assert [x.top for x in r] == [None, "D", None]
    assert [x.d for x in r] == [3, 5, 3]


@pytest.mark.parametrize("pat", ["*.tmp", "~$*", "ntuser.dat*", "[!a]bc", "[a-c]x", ".~lock.*", "x[", "a?b", "[]]z"])
def test_glob_matches_fnmatch(pat):
    names = ["a.tmp", "~$foo", "ntuser.dat.log", "xbc", "abc", "bx", "dx", ".~lock.f#", "x[", "aab", "]z", ".tmp"]
    rx = re.compile(globs_regex([pat]))
    for n in names:
        assert bool(rx.search(n)) == fnmatch.fnmatchcase(n, pat), (pat, n)


def _py_fmt(b, decimals, use_abs, units, last):
    for u in units:
        if (abs(b) if use_abs else b) < 1024.0:
            return f"{b:.{decimals}f} {u}"
        b /= 1024.0
    return f"{b:.{decimals}f} {last}"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(min_value=-(1 << 52), max_value=1 << 52), min_size=1, max_size=20))
def test_size_text_matches_python(spark, values):
    values = values + [100, 1024, 1024 ** 2, 1024 ** 3, 1280, 1536, -1280]
    df = spark.createDataFrame([(v,) for v in values], "b bigint")
    rows = df.select(size_text_signed(F.col("b")).alias("a"), size_text(F.col("b")).alias("c"),
                     size_text_2(F.col("b")).alias("d")).collect()
    u5 = ["B", "KB", "MB", "GB", "TB"]
    for v, r in zip(values, rows):
        assert r.a == _py_fmt(v, 1, True, u5, "PB")
        assert r.c == _py_fmt(v, 1, False, u5, "PB")
        assert r.d == _py_fmt(v, 2, False, u5[:4], "TB")


def test_size_text_examples(spark):
    df = spark.createDataFrame([(100,), (1024,), (1024 ** 2,), (1024 ** 3,)], "b bigint")
    assert [r[0] for r in df.select(size_text(F.col("b"))).collect()] == ["100.0 B", "1.0 KB", "1.0 MB", "1.0 GB"]
    assert [r[0] for r in df.select(size_text_2(F.col("b"))).collect()] == ["100.00 B", "1.00 KB", "1.00 MB", "1.00 GB"]


def test_python_title(spark):
    words = ["movies", "home videos", "2x", "o'neil", "ÉTÉ été", "mIxEd_case"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(P.python_title(F.col("w"))).collect()] == [w.title() for w in words]


def test_keeper_score_flags(spark):
    df = spark.createDataFrame([("/r/a/Copy of x.txt",), ("/r/x (2).txt",),
                                ("/r/123e4567-e89b-12d3-a456-426614174000/x.txt",), ("/r/plain.txt",)], "path string")
    s = df.select(P.keeper_score("path", P.name_of("path")).alias("s")).collect()
    assert [(x.s.copy_rank, x.s.uuid_rank, x.s.parens_rank) for x in s] == [
        (0, 1, 1), (0, 1, 0), (1, 0, 1), (1, 1, 1)]


def test_normalized_name(spark):
    import unicodedata
    words = [" Vidéos ", "ÉTÉ", "Crème Brûlée", "plain", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(P.normalized_name(F.col("w"))).collect()]
    exp = [None if w is None else "".join(c for c in unicodedata.normalize("NFD", w.strip())
                                          if unicodedata.category(c) != "Mn").lower() for w in words]
    assert got == exp


def test_names_and_parents_equal_their_regexes(spark):
    """The string functions against the patterns that define them."""
    import re
    paths = ["/a/b.txt", "/a", "/", "/a/", "a", "", "/r/x/y.tar.GZ", "/r/.bashrc", "/r/f.", "/r/..x", "/r/a.b\n", "/r/é/ü.É", "/r//d", "/r/文.文", "/r/..", "/r/.", "/r/a b.c d", "/rr/x"]
    rows = [(p, i) for i, p in enumerate(paths)] + [(None, -1)]
    df = spark.createDataFrame(rows, "path string, i int")
    got = df.select("path", P.name_of("path").alias("n"), P.parent_of("path").alias("p"), P.raw_suffix(P.name_of("path")).alias("s"),
                    P.rel_parent("path", "/r").alias("rp"), P.top_of("path", "/r/").alias("top")).collect()
    for r in got:
        if r.path is None:
            assert r[1:] == (None,) * 5
            continue
        assert r.n == re.search(r"[^/]*\Z", r.path).group()
        assert r.p == (re.sub(r"/[^/]*\Z", "", r.path) or "/" if "/" in r.path else r.path)
        m = re.search(r"(?s)\A.+([.][^.]+)\Z", r.n)
        assert r.s == (m.group(1) if m else "")
        rel = r.path[3:] if r.path.startswith("/r/") else None
        assert r.rp == (None if rel is None else re.sub(r"/?[^/]*\Z", "", rel))
        assert r.top == (None if not r.rp else r.rp.split("/")[0])
