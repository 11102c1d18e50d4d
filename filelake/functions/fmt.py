"""Human-readable sizes (PF21-PF23) as Column expressions.

``bround`` (half-even on the decimal value) before ``%.Nf`` reproduces
Python's formatting for the dyadic values these divisions produce; plain
``format_string`` rounds half-up (1.25 -> '1.3' instead of '1.2').
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(col: Column, decimals: int = 1, use_abs: bool = True,
               units=("B", "KB", "MB", "GB", "TB"), last: str = "PB") -> Column:
    x = col.cast("double")
    test = F.abs(x) if use_abs else x
    fmt = f"%.{decimals}f"

    def text(k: int, unit: str) -> Column:
        v = x / float(1024 ** k)
        return F.concat(F.format_string(fmt, F.bround(v, decimals)), F.lit(" " + unit))

    expr = None
    for k, unit in enumerate(units):
        cond = test < float(1024 ** (k + 1))
        expr = F.when(cond, text(k, unit)) if expr is None else expr.when(cond, text(k, unit))
    return expr.otherwise(text(len(units), last))


def size_text_signed(col: Column) -> Column:
    """1 decimal, units chosen on the absolute value (snapshot diff, PF21)."""
    return human_size(col, 1, True)


def size_text(col: Column) -> Column:
    """1 decimal, B..TB then PB (dedup/consolidate reports, PF22)."""
    return human_size(col, 1, False)


def size_text_2(col: Column) -> Column:
    """2 decimals, B..GB then TB (clean/rename reports, PF23)."""
    return human_size(col, 2, False, units=("B", "KB", "MB", "GB"), last="TB")
