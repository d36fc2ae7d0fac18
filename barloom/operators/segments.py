"""Series cut at missing bars, and long segments cut into chunks that tasks can share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.slots import BLOCK, SERIES, readings

#: Bars of one chunk. Chunks borrow the bars before them that trailing formulas need.
CHUNK = 16_384


def segmented(bars: DataFrame, keys: Sequence[str] = SERIES, block: int = BLOCK) -> DataFrame:
    """Adds segment_id (0, 1, ... per series), segment_start (slot) and pos (0, 1, ... within the segment).

    ``bars`` has one row per slot: ``keys``, block (slot_no by BLOCK) and slot_no. A segment is a run of adjacent
    slots. Rows stay in their blocks; only one row per block travels to carry segments across blocks.
    """
    w = Window.partitionBy(*keys, "block").orderBy("slot_no")
    prev = F.lag("slot_no").over(w)
    b = bars.withColumn("prev_", prev)
    b = b.withColumn("new_", (F.col("prev_").isNotNull() & (F.col("prev_") != F.col("slot_no") - 1)).cast("int"))
    b = b.withColumn("nth_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("start_", F.max(F.when(F.col("new_") == 1, F.col("slot_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = b.groupBy(*keys, "block").agg(
        F.min("slot_no").alias("lo"), F.max("slot_no").alias("hi"), F.sum("new_").alias("cuts"), F.max("start_").alias("in_start"))
    s = Window.partitionBy(*keys).orderBy("block")
    edge = edge.withColumn("before_", F.lag("hi").over(s)).withColumn("joins_", F.coalesce(F.col("before_") == F.col("lo") - 1, F.lit(False)))
    # A block that does not continue the one before starts a segment of its own.
    edge = edge.withColumn("own_", F.when(F.col("before_").isNotNull() & ~F.col("joins_"), 1).otherwise(0))
    upto = s.rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("base_", F.sum(F.col("cuts") + F.col("own_")).over(upto) - F.col("cuts"))
    edge = edge.withColumn("begins_", F.when(~F.col("joins_"), F.col("lo")))
    edge = edge.withColumn("newest_", F.coalesce("in_start", "begins_"))
    edge = edge.withColumn("carry_", F.coalesce("begins_", F.last("newest_", True).over(s.rowsBetween(Window.unboundedPreceding, -1))))
    edges = edge.select(*keys, "block", "base_", "carry_")
    out = b.join(edges, [*keys, "block"])
    out = out.withColumn("segment_id", (F.col("base_") + F.col("nth_")).cast("long"))
    out = out.withColumn("segment_start", F.coalesce("start_", "carry_"))
    return out.withColumn("pos", F.col("slot_no") - F.col("segment_start")).drop(
        "prev_", "new_", "nth_", "start_", "base_", "carry_")


def segment_table(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per segment: segment_id, segment_start, segment_end, bars, gap_size_bars (missing before it).
    Partial sums first; what is left of a series is one row per segment."""
    g = bars.groupBy(*keys, "segment_id").agg(F.min("slot_no").alias("segment_start"), F.max("slot_no").alias("segment_end"), F.count("*").alias("bars"))
    gap = F.col("segment_start") - F.lag("segment_end").over(Window.partitionBy(*keys).orderBy("segment_id")) - 1
    return g.withColumn("gap_size_bars", F.coalesce(gap, F.lit(0)))


def chunked(bars: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """Segmented bars in chunks: adds chunk and own. The last ``halo`` bars of a chunk are repeated at the head of
    the next one with own = False, so trailing formulas of up to ``halo`` bars see all they need. A segment
    shorter than ``size`` is one chunk and nothing is repeated."""
    home = F.floor(F.col("pos") / F.lit(size)).cast("long")
    # A bar is also a forerunner of every following chunk that begins within the halo.
    last = F.floor((F.col("pos") + halo) / F.lit(size)).cast("long")
    c = bars.withColumn("chunk", F.explode(F.sequence(home, last)))
    return c.withColumn("own", F.col("chunk") == home)


def clean_bars(klines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Readings whose prices and volumes are all present; a bar without them counts as missing."""
    r = readings(klines, list(dict.fromkeys(["open", "high", "low", "close", "volume", *columns]))).drop("own")
    ok = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return r.where(ok)
