"""Aggregate and arithmetic expressions that stay null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounds the number itself, not its shortest decimal text: 0.00015 is below the tie."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def safe_corr(a: Column, b: Column, nullable: bool = True) -> Column:
    """Pearson correlation over the rows where both sides are present.

    Null when either side is constant there. ``nullable=False`` leaves the null
    masks out, so the standard deviation of a column is computed once however
    many pairs it is in.
    """
    left = F.when(b.isNotNull(), a) if nullable else a
    right = F.when(a.isNotNull(), b) if nullable else b
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(left) * F.stddev_pop(right))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
