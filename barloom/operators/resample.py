"""Bars of a finer timeframe to complete bars of a coarser one, and the comparison with native bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.slots import DAY_US, SERIES, step_us

SUMS = ("volume", "quote_volume", "trade_count", "taker_buy_volume")


def _ratio(source_us: Column, target_us: int) -> Column:
    return F.lit(target_us) / source_us


def resample(bars: DataFrame, target_us: int, keys: Sequence[str] = SERIES, sums: Sequence[str] = SUMS) -> DataFrame:
    """Complete buckets of ``target_us`` (a divisor of a day and a multiple of the source's step): keys, bucket,
    open, high, low, close and the sums. A bucket with fewer bars than it has slots is left out, so
    none spans a gap; series that are not finer than the target or do not divide it are left out too.

    ``bars`` has one row per slot. Partial aggregates are built where the bars lie; a bucket holds at
    most a day's slots whatever the size of its series.
    """
    if DAY_US % target_us:
        raise ValueError("the target must divide a day")
    step = step_us(F.col("timeframe"))
    fits = (F.lit(target_us) > step) & (F.pmod(F.lit(target_us), step) == 0)
    b = bars.where(fits).withColumn("n_", (F.lit(target_us) / step).cast("long"))
    b = b.withColumn("bucket", F.floor(F.col("slot_no") / F.col("n_")).cast("long"))
    g = b.groupBy(*keys, "bucket", "n_").agg(
        F.min_by("open", "slot_no").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "slot_no").alias("close"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count("close").alias("bars"))
    return g.where((F.col("bars") == F.col("n_")) & F.col("open").isNotNull() & F.col("close").isNotNull()).drop("n_")


def compare_native(resampled: DataFrame, native: DataFrame, keys: Sequence[str], fields: Sequence[str], rtol: float = 1e-9, atol: float = 1e-6, exact: Sequence[str] = ("trade_count",)) -> DataFrame:
    """Per ``keys`` without the bucket and per field: bars compared, mismatches, largest difference, and MATCH or
    MISMATCH. The tolerance is relative to the native value; a missing value agrees with nothing."""
    r = resampled.select(*keys, *[F.col(f).cast("double").alias(f"r_{f}") for f in fields])
    n = native.select(*keys, *[F.col(f).cast("double").alias(f"n_{f}") for f in fields])
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("r"), F.col(f"n_{f}").alias("n"),
                                        F.lit(0.0 if f in exact else rtol).alias("rt"), F.lit(0.0 if f in exact else atol).alias("at")) for f in fields]))
    j = r.join(n, list(keys)).select(*keys, pairs)
    far = ~F.coalesce(F.abs(F.col("r") - F.col("n")) <= F.col("at") + F.col("rt") * F.abs("n"), F.lit(False))
    group = [k for k in keys if k != "bucket"]
    out = j.groupBy(*group, "field").agg(
        F.count("*").alias("compared"), F.count_if(far).alias("mismatch_count"), F.max(F.abs(F.col("r") - F.col("n"))).alias("max_abs_diff"))
    return out.withColumn("status", F.when(F.col("mismatch_count") == 0, "MATCH").otherwise("MISMATCH"))


def source_policy(comparison: DataFrame, group: Sequence[str]) -> DataFrame:
    """NATIVE where every field of a group matches, else RESAMPLED."""
    g = comparison.groupBy(*group).agg(F.max((F.col("status") != "MATCH").cast("int")).alias("bad_"))
    return g.select(*group, F.when(F.col("bad_") == 0, "NATIVE").otherwise("RESAMPLED").alias("policy"))


def resample_contiguous(bars: DataFrame, target_us: int, keys: Sequence[str] = SERIES, sums: Sequence[str] = SUMS) -> DataFrame:
    """Complete buckets of segmented bars, runs between gaps apart: as resample(), and where the source already has the
    target's step its bars themselves, except those of runs of one bar, whose step nothing shows. A finer bucket that is
    complete cannot span a gap, so the run needs to be no key of it."""
    same = step_us(F.col("timeframe")) == target_us
    lone = Window.partitionBy(*keys, "segment_id", F.floor(F.col("pos") / 2))
    # A run has a second bar exactly if the pair of its first two positions is whole.
    own = bars.where(same).withColumn("pair_", F.count("*").over(lone)).where((F.col("pair_") > 1) | (F.col("pos") > 1))
    own = own.select(*keys, F.col("slot_no").alias("bucket"), "open", "high", "low", "close", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], F.lit(1).cast("long").alias("bars"))
    return resample(bars.where(~same), target_us, keys, sums).unionByName(own)
