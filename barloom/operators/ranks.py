"""Positions, running sums, ranks and exact quantiles of groups of any size.

Distinct values are counted where they lie, cut into ranges of (group, value) and written; a range then only needs
what lies before it in its group, one row per group and range. No group is sorted or held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.materialize import measured_broadcast, written


def _ranges(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    there = F.col(order).isNotNull()
    for g in group:
        there = there & F.col(g).isNotNull()
    c = df.where(there).groupBy(*group, order).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in sums])
    return written(c.repartitionByRange(*group, order).withColumn("range_", F.spark_partition_id()), "ranges")


def running(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str] = ()) -> DataFrame:
    """One row per group and distinct value of ``order``: n rows that have it, ``below`` (rows of the group with a smaller
    one) and, of the columns ``sums``, {c} over its rows and below_{c} over the smaller ones. NULL orders and NULL groups
    are left out."""
    return _running(_ranges(df, group, order, sums), group, order, sums)


def _running(c: DataFrame, group: Sequence[str], order: str, sums: Sequence[str] = ()) -> DataFrame:
    totals = c.groupBy(*group, "range_").agg(F.sum("n").alias("tn_"), *[F.sum(x).alias(f"t_{x}") for x in sums])
    before = Window.partitionBy(*group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    totals = totals.select(*group, "range_", zero(F.sum("tn_").over(before)).alias("tn_"), *[zero(F.sum(f"t_{x}").over(before)).alias(f"t_{x}") for x in sums])
    inside = Window.partitionBy(*group, "range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return c.join(totals, [*group, "range_"]).select(
        *group, order, "n", *sums, (F.col("tn_") + zero(F.sum("n").over(inside))).alias("below"),
        *[(F.col(f"t_{x}") + zero(F.sum(x).over(inside))).alias(f"below_{x}") for x in sums])


def with_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank from 1 of a value in its group, ties sharing their mean rank. Rows without a value have none."""
    return _ranked(df, running(df, group, value), group, value, name)


def _ranked(df: DataFrame, r: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    return df.join(r.select(*group, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name)), [*group, value], "left")


def quantiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[float], name: str, least: int = 1) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each group with at least ``least`` values: group, n_, and an array in
    the order of ``at``. NULL and NaN values are no values."""
    c = _ranges(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), group, value, ())
    return _quantiles(c, _running(c, group, value), group, value, at, name, least)


def rank_and_quantiles(df: DataFrame, group: Sequence[str], value: str, rank: str, at: Sequence[float], name: str) -> tuple[DataFrame, DataFrame]:
    """with_rank() and quantiles() of one value from the same ranges."""
    c = _ranges(df, group, value, ())
    r = _running(c, group, value)
    there = ~F.isnan(F.col(value).cast("double"))
    # NaN is above every number, so it moves no other position.
    return _ranked(df, r, group, value, rank), _quantiles(c.where(there), r.where(there), group, value, at, name, 1)


def _quantiles(c: DataFrame, r: DataFrame, group: Sequence[str], value: str, at: Sequence[float], name: str, least: int) -> DataFrame:
    r = r.select(*group, F.col(value).cast("double").alias("v_"), "n", "below")
    total = c.groupBy(*group).agg(F.sum("n").alias("n_")).where(F.col("n_") >= least)
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("k_"), F.lit(float(p)).alias("p_")) for k, p in enumerate(at)]))
    w = total.select(*group, "n_", want.alias("w_")).select(*group, "n_", "w_.k_", (F.col("w_.p_") * (F.col("n_") - 1)).alias("pos_"))
    w = measured_broadcast(w)
    holds = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
    lo, hi = F.floor("pos_"), F.ceil("pos_")
    j = r.join(w, list(group)).where(holds(lo) | holds(hi))
    q = j.groupBy(*group, "n_", "k_", "pos_").agg(F.max(F.when(holds(lo), F.col("v_"))).alias("a_"), F.max(F.when(holds(hi), F.col("v_"))).alias("b_"))
    x = F.col("a_") + (F.col("b_") - F.col("a_")) * (F.col("pos_") - F.floor("pos_"))
    return q.groupBy(*group, "n_").agg(F.transform(F.sort_array(F.collect_list(F.struct("k_", x.alias("x_")))), lambda s: s["x_"]).alias(name))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every run and engine."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
