"""Aggregates that ANSI mode would otherwise turn into errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are known; null when a side does not vary.

    The built-in `corr` divides by zero for a constant column.
    """
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)
