"""Shell-style globs (``* ? [seq] [!seq]``, case-sensitive, whole name) turned
into one regex on the driver; the match itself is a JVM ``rlike`` (FL5-FL7)."""

from __future__ import annotations

from pyspark.sql import Column

_META = set("\\.^$|?*+()[]{}")
_CLASS_META = set("\\[]&~|^")


def _esc(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def glob_to_regex(pattern: str, segment: bool = False) -> str:
    """Regex body (no anchors) for one glob.  With ``segment=True`` the
    wildcards never cross '/', for matching folder names inside a path."""
    any_char = "[^/]" if segment else "."
    out, i, n = [], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(any_char + "*")
        elif ch == "?":
            out.append(any_char)
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
                continue
            body = pattern[i:j]
            i = j + 1
            negate = body.startswith("!")
            if negate:
                body = body[1:]
            parts, k = [], 0
            while k < len(body):
                c = body[k]
                if k + 2 < len(body) and body[k + 1] == "-":
                    lo, hi = body[k], body[k + 2]
                    if lo <= hi:
                        parts.append(f"{_cls(lo)}-{_cls(hi)}")
                    k += 3
                    continue
                parts.append(_cls(c))
                k += 1
            if not parts:
                # an empty or reversed-only set matches nothing / anything
                out.append("[^/]" if negate and segment else ("." if negate else "(?!)"))
                continue
            out.append(("[^" if negate else "[") + "".join(parts) + "]")
        else:
            out.append(_esc(ch))
    return "".join(out)


def _cls(ch: str) -> str:
    return "\\" + ch if ch in _CLASS_META else ch


def globs_regex(patterns, segment: bool = False) -> str:
    """Alternation of several globs, anchored on the whole string."""
    body = "|".join(f"(?:{glob_to_regex(p, segment)})" for p in patterns)
    return f"(?s)^(?:{body})$"


def name_matches_any(name: Column, patterns) -> Column:
    """True when the name matches at least one glob."""
    return name.rlike(globs_regex(patterns))
