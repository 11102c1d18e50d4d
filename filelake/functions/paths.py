"""Path projections as Spark Column expressions (all JVM-side, codegen'd).

Paths are POSIX strings.  ``root`` is the folder the verb works on; every
"relative" helper is relative to it.  Regexes use ``[0-9]`` rather than
``\\d`` and ``[.]`` rather than ``\\.`` where that reads better, so that the
same text works in Java regex and RE2.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from filelake import constants as C

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_root(root: str) -> str:
    """'/drive/' -> '/drive', '/' -> '' (so that root + '/' is the prefix)."""
    return root.rstrip("/")


# --- names ---------------------------------------------------------------

def name_of(path: ColumnOrName) -> Column:
    """Last path component."""
    return F.substring_index(_c(path), "/", -1)


def _above(p: Column) -> Column:
    """The text before the last '/'; '' when there is none."""
    return F.when(p.contains("/"), p.substr(F.lit(1), F.length(p) - F.length(name_of(p)) - 1)).otherwise(F.when(p.isNotNull(), ""))


def parent_of(path: ColumnOrName) -> Column:
    """Everything before the last '/'; '/' for a file directly under '/'."""
    p = _c(path)
    up = _above(p)
    return F.when(~p.contains("/"), p).when(up == "", F.lit("/")).otherwise(up)


def raw_suffix(name: ColumnOrName) -> Column:
    """Suffix with its dot, original case: 'a.tar.GZ' -> '.GZ'; '.bashrc',
    'f.' and 'README' have none ('')."""
    n = _c(name)
    last = F.substring_index(n, ".", -1)
    has = n.contains(".") & (last != "") & (F.length(last) + 1 < F.length(n))
    return F.when(has, F.concat(F.lit("."), last)).otherwise(F.when(n.isNotNull(), ""))


def ext_of(name: ColumnOrName) -> Column:
    """Lower-cased extension with dot, '' when there is none (PF4)."""
    return F.lower(raw_suffix(name))


def stem_of(name: ColumnOrName) -> Column:
    """Name without its suffix (PF5)."""
    n = _c(name)
    return n.substr(F.lit(1), F.length(n) - F.length(raw_suffix(n)))


def depth_of(path: ColumnOrName) -> Column:
    """Number of parts of an absolute path, '/' counting as one (PF6)."""
    return F.size(F.split(_c(path), "/"))


# --- relative to a root -----------------------------------------------------

def under_root(path: ColumnOrName, root: str) -> Column:
    return _c(path).startswith(norm_root(root) + "/")


def rel_path(path: ColumnOrName, root: str) -> Column:
    """Path below ``root`` ('Documents/a/b.txt'); NULL when not under it (PF7)."""
    r = norm_root(root)
    p = _c(path)
    return F.when(p.startswith(r + "/"), p.substr(len(r) + 2, 1 << 30))


def rel_parent(path: ColumnOrName, root: str) -> Column:
    """Folder of the file below root: 'Documents/a' for 'Documents/a/b.txt',
    '' for a file directly in root."""
    return _above(rel_path(path, root))


def rel_dirs(path: ColumnOrName, root: str) -> Column:
    """Folder names between root and the file, as an array (may be empty)."""
    rp = rel_parent(path, root)
    return F.when(rp == "", F.array().cast("array<string>")).otherwise(F.split(rp, "/"))


def top_of(path: ColumnOrName, root: str) -> Column:
    """First folder below root; NULL for files directly in root (PF7)."""
    rp = rel_parent(path, root)
    return F.when(rp != "", F.substring_index(rp, "/", 1))


def dir_matches(rel_parent_col: Column, dir_regex: str) -> Column:
    """True when any folder name of a relative parent string fully matches
    ``dir_regex`` (an alternation of folder-name regexes without '/')."""
    return rel_parent_col.rlike(f"(^|/)({dir_regex})(/|$)")


def dir_contains_any(rel_parent_col: Column, needles) -> Column:
    """True when any folder name contains any needle (FL11).  Needles hold
    no '/', so a substring test on the joined string is exact."""
    cond = F.lit(False)
    for s in needles:
        cond = cond | (F.instr(rel_parent_col, s) > 0)
    return cond


# --- keeper score (dedup) ---------------------------------------------------

def has_copy_marker(name: ColumnOrName) -> Column:
    """Copy markers in the lower-cased name (PF8)."""
    low = F.lower(_c(name))
    cond = F.lit(False)
    for m in C.COPY_MARKERS:
        cond = cond | low.contains(m)
    return cond


def has_uuid(path: ColumnOrName) -> Column:
    """UUID anywhere in the lower-cased whole path (PF9)."""
    return F.lower(_c(path)).rlike(C.UUID_REGEX)


def has_parens_number(name: ColumnOrName) -> Column:
    """'(digits)' anywhere in the name (PF10)."""
    return _c(name).rlike(r"\([0-9]+\)")


def keeper_score(path: ColumnOrName, name: ColumnOrName) -> Column:
    """(depth, copy?0:1, uuid?0:1, parens?0:1): lower wins (PF11).  Structs
    compare field by field, so ``min`` of this struct is the best path."""
    return F.struct(
        depth_of(path).alias("depth"),
        F.when(has_copy_marker(name), 0).otherwise(1).alias("copy_rank"),
        F.when(has_uuid(path), 0).otherwise(1).alias("uuid_rank"),
        F.when(has_parens_number(name), 0).otherwise(1).alias("parens_rank"),
    )


# --- title case as str.title() does it (PF18) ---------------------------------

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def python_title(s: ColumnOrName) -> Column:
    """Python ``str.title()``: every run of cased letters gets an upper-case
    first letter and lower-case rest; anything else is kept.  Spark's
    ``initcap`` only starts words after blanks ('2x' -> '2x' not '2X')."""
    tokens = F.regexp_extract_all(_c(s), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), 0)
    fixed = F.transform(
        tokens,
        lambda t: F.when(
            t.rlike(f"^[{_CASED}]"),
            F.concat(F.upper(t.substr(1, 1)), F.lower(t.substr(F.lit(2), F.length(t)))),
        ).otherwise(t),
    )
    return F.array_join(fixed, "")


def derive(manifest, root: str):
    """Add the derived columns most verbs use (name, ext, stem, depth,
    rel_parent, top) unless the manifest already carries them."""
    df = manifest
    if "name" not in df.columns:
        df = df.withColumn("name", name_of("path"))
    if "parent" not in df.columns:
        df = df.withColumn("parent", parent_of("path"))
    if "ext" not in df.columns:
        df = df.withColumn("ext", ext_of("name"))
    return (df.withColumn("rel_parent", rel_parent("path", root))
              .withColumn("top", top_of("path", root)))


# --- accent-insensitive form of a name (PF17) -------------------------------------

_NFD_UDF = None


def normalized_name(name: ColumnOrName) -> Column:
    """strip, NFD, drop combining marks, lower-case.  Spark has no Unicode
    normalisation function, so a vectorised pandas UDF does that step alone;
    apply it to distinct names and join back when names repeat.  (For
    comparisons only, ``collate(x, 'UNICODE_CI_AI')`` needs no Python.)"""
    global _NFD_UDF
    if _NFD_UDF is None:  # built on first use: a UDF needs a live session
        def nfd(s: pd.Series) -> pd.Series:  # nested, so it travels by value: workers need no package
            return s.str.strip().str.normalize("NFD")

        _NFD_UDF = F.pandas_udf(nfd, "string")
    return F.lower(F.regexp_replace(_NFD_UDF(_c(name)), r"\p{Mn}+", ""))
