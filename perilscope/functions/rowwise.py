"""Row-wise functions across several columns.

Each is one codegen'd expression over a fixed list of columns; none needs
an array allocation or a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def row_count_nonnull(cols: Sequence[Column | str]) -> Column:
    """Number of present values (``hazard_count``)."""
    out = F.lit(0)
    for c in cols:
        out = out + col(c).isNotNull().cast("int")
    return out


def row_sum(cols: Sequence[Column | str]) -> Column:
    """Sum skipping missing values; all missing → 0."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(col(c).cast("double"), F.lit(0.0))
    return out


def row_sum_strict(cols: Sequence[Column | str]) -> Column:
    """A15 (``+`` form): any missing value gives null."""
    out = col(cols[0])
    for c in cols[1:]:
        out = out + col(c)
    return out


def row_mean(cols: Sequence[Column | str]) -> Column:
    """Mean of present values; all missing → null."""
    n = row_count_nonnull(cols)
    return F.when(n > 0, F.try_divide(row_sum(cols), n))


def row_argmax(cols: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Name (or label) of the largest column, missing values skipped,
    the first column in list order wins ties; all missing → null."""
    labels = list(labels) if labels is not None else list(cols)
    top = F.greatest(*[col(c) for c in cols])
    out = None
    for c, lab in zip(cols, labels):
        cond = col(c) == top
        out = (F.when(cond, F.lit(lab)) if out is None
               else out.when(cond, F.lit(lab)))
    return out


def fill_row_mean(c: Column | str, cols: Sequence[Column | str],
                  default: float = 0.0) -> Column:
    """missing → row mean of ``cols`` → ``default``."""
    return F.coalesce(col(c), row_mean(cols), F.lit(default))
