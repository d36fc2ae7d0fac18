"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def sdiv(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return a / F.nullif(b, F.lit(0.0))


def number(c: Column) -> Column:
    """A double with NaN and infinities as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def rolling(agg, x: Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over the last n rows; NULL until n rows without a NULL are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    """Distance of the current value from the mean of the last n, in their standard deviations (population)."""
    return sdiv(x - rolling(F.avg, x, w, n), rolling(F.stddev_pop, x, w, n))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs without a NULL; NULL for fewer than three pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (F.count(a) >= 3)
    return F.when(varies, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
