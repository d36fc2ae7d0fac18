"""Totals and averages over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import number
from barloom.sources.tables import require_columns

#: Digits behind the point that the sums keep exactly.
SCALE = 9


def rolling_totals(
    days: DataFrame, entity: Sequence[str], day: str, measures: Sequence[str], periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """Trailing totals and averages of each measure for every row of ``days``, which has one row for
    every day of an entity, idle days included (see regular_grid).

    Adds total_{measure}_{period} (decimal), rest_{measure}_{period} (double) and avg_{measure}_{period} (double: total
    and rest divided by the days of the period that exist so far). A period ends with the day itself. The total is exact
    for values of up to 21 digits before the point and nine behind it; what of a value lies beyond is summed in the
    rest, which is exactly 0 where there is none. Null, NaN and infinite values count as 0. An empty table stays empty.

    A running (prefix) sum per entity is the only pass over the data; a period's total is the difference
    between the prefix at its end and the prefix just before its start. The prefix is a decimal, so
    a period of idle days gives exactly 0 however large the sums before it were; the rest's prefix repeats over idle
    days, so its difference is 0 too. An entity has one row per calendar day, which bounds what one window holds
    whatever the size of the table.
    """
    require_columns(days, {*entity, day, *measures})
    w = Window.partitionBy(*entity).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("day_no_", F.row_number().over(w))
    for m in measures:
        v = F.coalesce(number(F.col(m)), F.lit(0.0))
        whole = F.coalesce(F.when(F.abs(v) < 1e21, v).try_cast(f"decimal(30,{SCALE})"), F.lit(0).cast(f"decimal(30,{SCALE})"))
        out = out.withColumn(f"prefix_{m}_", F.sum(whole).over(upto)).withColumn(f"over_{m}_", F.sum(v - whole.cast("double")).over(upto))
    zero = F.lit(0).cast(f"decimal(38,{SCALE})")
    cols = []
    for m in measures:
        for p in periods:
            total = F.col(f"prefix_{m}_") - F.coalesce(F.lag(f"prefix_{m}_", p).over(w), zero)
            rest = F.col(f"over_{m}_") - F.coalesce(F.lag(f"over_{m}_", p).over(w), F.lit(0.0))
            cols += [total.cast(f"decimal(38,{SCALE})").alias(f"total_{m}_{p}"), rest.alias(f"rest_{m}_{p}"),
                     ((total.cast("double") + rest) / F.least("day_no_", F.lit(p))).alias(f"avg_{m}_{p}")]
    return out.select(*days.columns, F.col("day_no_").alias("day_no"), *cols)
