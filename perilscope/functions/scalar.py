"""Scalar column functions.

All are JVM-side expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RISK_BOUNDS, RISK_LABELS, RISK_REST


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log1p(c: Column | str) -> Column:
    """``ln(1 + x)``; null stays null."""
    return F.log1p(col(c))


def bin_period(year: Column | str, size: int) -> Column:
    """``floor(year / size) * size`` — floor, not truncation (−3 → −5)."""
    return (F.floor(col(year) / F.lit(size)) * F.lit(size)).cast("int")


def value_or_zero_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` when ``den > 0``, else 0 (missing ``den`` → 0)."""
    d = col(den)
    return F.when(d > 0, F.try_divide(col(num), d)).otherwise(F.lit(0.0))


def scale(c: Column | str, k: float) -> Column:
    """Multiply by a constant."""
    return col(c) * F.lit(k)


def fill_const(c: Column | str, value: float) -> Column:
    """missing → constant."""
    return F.coalesce(col(c), F.lit(value))


def fill_column(c: Column | str, other: Column | str) -> Column:
    """missing → another column's value."""
    return F.coalesce(col(c), col(other))


def risk_bucket(rank: Column | str, bounds: Sequence[int] = RISK_BOUNDS,
                labels: Sequence[str] = RISK_LABELS,
                rest: str = RISK_REST) -> Column:
    """F8: label of the first bound the rank does not exceed."""
    r = col(rank)
    out = None
    for b, lab in zip(bounds, labels):
        out = (F.when(r <= b, F.lit(lab)) if out is None
               else out.when(r <= b, F.lit(lab)))
    return out.otherwise(F.lit(rest))


def weighted_sum(cols: Sequence[Column | str],
                 weights: Sequence[float]) -> Column:
    """``Σ w_i * c_i``; any missing component gives null."""
    terms = [F.lit(w) * col(c) for c, w in zip(cols, weights)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def clamp(c: Column | str, lo: float | None = None,
          hi: float | None = None) -> Column:
    """P16 helper: ``least(hi, greatest(lo, c))``."""
    out = col(c)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return out


def round_for_compare(c: Column | str, places: int = 6) -> Column:
    """Round a double and turn −0.0 into 0.0 (result hand-off only)."""
    return F.round(col(c), places) + F.lit(0.0)
