"""Scan-time filters (FL1-FL14).  All are plain Column predicates, so they
are evaluated in the scan stage (and pushed into the reader where the
source allows it) before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P
from filelake.functions.globs import glob_to_regex, globs_regex


def _lit_regex(s: str) -> str:
    return "".join("\\" + ch if ch in "\\.^$|?*+()[]{}" else ch for ch in s)


def skip_regex_glob(names) -> str:
    """Folder names skipped exactly, or by glob when they contain '*' (FL8)."""
    alts = []
    for n in names:
        alts.append(_lit_regex(n))
        if "*" in n:
            alts.append(glob_to_regex(n, segment=True))
    return "|".join(alts) if alts else "(?!)"


def skip_regex_exact(names) -> str:
    """Folder names skipped on exact equality only (FL9)."""
    return "|".join(_lit_regex(n) for n in names) if names else "(?!)"


def skip_regex_prefix(names) -> str:
    """Exact names, or prefixes for entries with '*' (FL10)."""
    alts = []
    for n in names:
        alts.append(_lit_regex(n))
        if "*" in n:
            alts.append(_lit_regex(n.replace("*", "")) + "[^/]*")
    return "|".join(alts) if alts else "(?!)"


def not_in_dirs(rel_parent: Column, dir_regex: str) -> Column:
    return ~P.dir_matches(rel_parent, dir_regex)


def min_size(size: Column, n: int) -> Column:
    """FL1."""
    return size >= F.lit(n)


def non_empty(size: Column) -> Column:
    """FL2."""
    return size > 0


def not_symlink(df: DataFrame) -> Column:
    """FL3 (no column -> nothing is a symlink)."""
    return ~F.coalesce(F.col("is_symlink"), F.lit(False)) if "is_symlink" in df.columns else F.lit(True)


def not_hidden(name: Column) -> Column:
    """FL4."""
    return ~name.startswith(".")


def include_any(name: Column, patterns) -> Column:
    """FL5: name matches at least one glob (no patterns -> everything)."""
    return name.rlike(globs_regex(patterns)) if patterns else F.lit(True)


def exclude_all(name: Column, patterns) -> Column:
    """FL6: name matches none of the globs."""
    return ~name.rlike(globs_regex(patterns)) if patterns else F.lit(True)


def ext_in_preset(ext: Column, preset: str) -> Column:
    """FL12: 'all' is the union of every preset (SO1); unknown -> nothing."""
    if preset == "all":
        exts = sorted({e for v in C.PRESETS.values() for e in v})
    else:
        exts = list(C.PRESETS.get(preset, ()))
    return ext.isin(exts) if exts else F.lit(False)


def is_junk(name: Column, extra_patterns=()) -> Column:
    """FL13: one regex over the default junk globs plus custom ones."""
    return name.rlike(globs_regex(list(C.JUNK_PATTERNS) + list(extra_patterns or ())))


def not_protected(rel_parent: Column, protected) -> Column:
    """FL11: no folder below root contains a protected substring."""
    return ~P.dir_contains_any(rel_parent, protected)


def readable(md5: Column) -> Column:
    """FL14: rows with a hash take part in grouping; the rest is reported."""
    return md5.isNotNull()
