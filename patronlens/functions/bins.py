"""Column expressions for binning, clipping and guarded arithmetic.

All of them are plain CASE expressions over literals, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def clip(column: Column | str, low=None, high=None) -> Column:
    """Values outside [low, high] become the bound; null stays null (unlike greatest/least)."""
    c = _col(column)
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    return out


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient with 0 where it is undefined."""
    return F.coalesce(F.try_divide(_col(numerator), _col(denominator)), F.lit(0.0))


def round_half_even(column: Column | str, digits: int = 2) -> Column:
    """Scale, round half to even, scale back: the usual array-library rounding of doubles."""
    factor = 10.0**digits
    return F.rint(_col(column) * factor) / factor


def cut(column: Column | str, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the fixed bin (low, high] that holds the value; null outside all bins."""
    if len(labels) != len(bins) - 1:
        raise ValueError("labels must be one fewer than bins")
    c = _col(column)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(bins[:-1], bins[1:], labels):
        out = out.when((c > low) & (c <= high), label)
    return out


def present(column: Column | str) -> Column:
    """The value as a double, null where it is missing; NaN counts as missing."""
    value = _col(column).cast("double")
    return F.when(~F.isnan(value), value)


def qcut_code(column: Column | str, edges: Sequence[float]) -> Column:
    """Bin number for distinct, ascending quantile ``edges``: right-closed, lowest edge included.

    Values beyond the outer edges fall in the outer bins; a missing value (null or NaN) has no bin. A single edge gives null, as there is no bin.
    """
    c = present(column)
    if len(edges) < 2:
        return F.lit(None).cast("int")
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for code, edge in enumerate(edges[1:-1]):
        out = out.when(c <= edge, code)
    return out.otherwise(len(edges) - 2)


def qcut_label(column: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the quantile bin; where equal edges were merged the lowest labels are used."""
    code = qcut_code(column, edges)
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for number, label in enumerate(labels[: max(len(edges) - 1, 1)]):
        out = out.when(code == number, label)
    return out
