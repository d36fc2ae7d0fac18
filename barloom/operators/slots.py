"""Readings of bar slots: which slot a delivery belongs to, and which of several deliveries counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import require_columns

SERIES = ("market", "symbol", "timeframe")
DAY_US = 86_400_000_000
#: Slots of one block. A block, not a series, is what one task sorts, so a series that holds a
#: third of all rows is spread over as many tasks as any other rows.
BLOCK = 2048


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp (without zone: read as UTC, the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def step_us(timeframe: Column) -> Column:
    """Microseconds of a timeframe such as 15m, 4h or 1d; NULL for anything else."""
    n = timeframe.substr(F.lit(1), F.length(timeframe) - 1).try_cast("int")
    unit = F.right(timeframe, F.lit(1))
    scale = (
        F.when(unit == "s", 1_000_000).when(unit == "m", 60_000_000).when(unit == "h", 3_600_000_000)
        .when(unit == "d", DAY_US).when(unit == "w", 7 * DAY_US)
    )
    return F.when(n > 0, n.cast("long") * scale)


def _slot(us: Column, step: Column) -> Column:
    # Both are below 2^53, so the quotient's floor is exact.
    return F.floor((us + F.when(step == DAY_US, 0).otherwise(F.floor(step / 2))) / step).cast("long")


def slot_no(open_time: Column, timeframe: Column) -> Column:
    """Number of the slot since 1970: of its UTC date for 1d, else the slot nearest to open_time."""
    return _slot(micros(open_time), step_us(timeframe))


def delivered(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Deliveries with their slot: SERIES, slot_no, ingested_us and the columns. Rows without a slot
    (null key, null open_time, unknown timeframe) belong to no series and are left out."""
    require_columns(bars, {*SERIES, "open_time", "ingested_at", *columns})
    there = F.col("market").isNotNull() & F.col("symbol").isNotNull() & F.col("open_time").isNotNull()
    # The filter stands on the columns as read: on the slot it would be computed once more, without
    # common subexpressions. Time and step get a projection of their own for the same reason.
    d = bars.where(there & step_us(F.col("timeframe")).isNotNull()).select(
        *SERIES, micros(F.col("open_time")).alias("us_"), step_us(F.col("timeframe")).alias("step_"), micros(F.col("ingested_at")).alias("ingested_us"), *columns)
    return d.select(*SERIES, _slot(F.col("us_"), F.col("step_")).alias("slot_no"), "ingested_us", *columns)


def readings(bars: DataFrame, columns: Sequence[str], halo: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per slot, the delivery ingested last, in blocks of adjacent slots.

    Columns: SERIES, block, slot_no, own (False for the ``halo`` slots borrowed from the neighbouring
    blocks) and ``columns``. One shuffle, on (series, block), and one sort serve this and every later
    window over (series, block) ordered by slot_no. Deliveries equal in ingested_at are equal in all
    columns; a null ingested_at loses to any other.
    """
    d = delivered(bars, columns)
    home = F.floor(F.col("slot_no") / F.lit(block)).cast("long")
    if halo:
        at = F.col("slot_no") - home * block
        d = d.withColumn("block", F.explode(F.array_compact(F.array(
            home, F.when(at < halo, home - 1), F.when(at >= block - halo, home + 1)))))
    else:
        d = d.withColumn("block", home)
    w = Window.partitionBy(*SERIES, "block").orderBy("slot_no", F.col("ingested_us").desc_nulls_last())
    first = d.withColumn("before", F.lag("slot_no").over(w))
    first = first.where(F.col("before").isNull() | (F.col("before") != F.col("slot_no")))
    return first.select(*SERIES, "block", "slot_no", (home == F.col("block")).alias("own"), *columns)
