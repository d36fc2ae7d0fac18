"""Irregular readings onto a regular grid: one row per slot of each audited range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.slots import BLOCK, SERIES, readings, slot_no
from barloom.sources.tables import require_columns

RANGE = (*SERIES, "from_no", "to_no")


def audited_ranges(audits: DataFrame) -> DataFrame:
    """Distinct ranges as slot numbers, both ends included. Rows with a null key or end, an unknown
    timeframe or an end before the start name no slots and are left out."""
    require_columns(audits, {*SERIES, "audited_from", "audited_to"})
    tf = F.col("timeframe")
    return audits.select(
        *SERIES, slot_no(F.col("audited_from"), tf).alias("from_no"), slot_no(F.col("audited_to"), tf).alias("to_no"),
    ).where((F.col("from_no") <= F.col("to_no")) & F.col("market").isNotNull() & F.col("symbol").isNotNull()).distinct()


def regular_grid(
    bars: DataFrame, audits: DataFrame, values: Sequence[str] = ("close",), fill: str = "mark",
    max_gap: int = 5, block: int = BLOCK,
) -> DataFrame:
    """One row per slot of each audited range: RANGE, block, slot_no, ``values`` and status.

    status is OBSERVED, NULL_VALUE (a reading whose first value is null) or MISSING (no reading).
    ``fill='linear'`` adds ``filled``: the first value, and inside gaps of at most ``max_gap`` slots
    between two non-null readings the line between them; longer gaps, and slots before the first
    or after the last reading, stay null. Overlapping ranges each get their own rows. An empty
    ``bars`` gives all slots as MISSING, empty ``audits`` no rows.

    Each pair of consecutive readings (lead) explodes only the grid times between them; a block's
    first row also explodes what precedes it, so ranges extend to their ends even where a block has
    no reading. Blocks, not series, are the unit of work. Across blocks only one row per block
    travels (the last and first reading, for the interpolation).
    """
    if fill not in ("mark", "linear"):
        raise ValueError("fill is 'mark' or 'linear'")
    first_value = values[0]
    seen = readings(bars, list(values), block=block).drop("own")
    ranges = audited_ranges(audits)
    blocks = ranges.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("from_no") / F.lit(block)), F.floor(F.col("to_no") / F.lit(block)))))
    blocks = blocks.select(
        *RANGE, "block", F.greatest("from_no", F.col("block") * block).alias("lo"),
        F.least("to_no", F.col("block") * block + (block - 1)).alias("hi"))
    if fill == "linear":
        blocks = _with_neighbours(blocks, seen, first_value)
    # The readings of a block outside its part of the range are dropped inside the join's condition-free
    # equi keys by nulling them first: a left join keeps every block, also those without a reading.
    b, r = blocks.alias("b"), seen.withColumnRenamed("slot_no", "at").alias("r")
    joined = b.join(r, [F.col(f"b.{k}") == F.col(f"r.{k}") for k in (*SERIES, "block")]
                    + [F.col("r.at").between(F.col("b.lo"), F.col("b.hi"))], "left")
    joined = joined.select("b.*", "r.at", *[F.col(f"r.{v}").alias(v) for v in values])
    w = Window.partitionBy(*RANGE, "block").orderBy("at")
    at, nxt, prev = F.col("at"), F.coalesce(F.lead("at").over(w), F.col("hi") + 1), F.lag("at").over(w)
    none = F.array().cast("array<bigint>")
    run = F.when(at.isNull(), F.sequence("lo", "hi")).otherwise(F.concat(
        F.when(F.col("prev").isNull() & (F.col("lo") < at), F.sequence(F.col("lo"), at - 1)).otherwise(none),
        F.sequence(at, F.col("next") - 1)))
    out = joined.withColumn("next", nxt).withColumn("prev", prev).withColumn("slot_no", F.explode(run))
    own = F.col("slot_no") == at
    status = F.when(own & F.col(first_value).isNotNull(), "OBSERVED").when(own, "NULL_VALUE").otherwise("MISSING")
    keep = [F.when(own, F.col(v)).alias(v) for v in values]
    if fill == "mark":
        return out.select(*RANGE, "block", "slot_no", *keep, status.alias("status"))
    out = out.select(*RANGE, "block", "slot_no", "left_no", "left_v", "right_no", "right_v", *keep, status.alias("status"))
    wb = Window.partitionBy(*RANGE, "block").orderBy("slot_no")
    there = F.when(F.col(first_value).isNotNull(), F.struct(F.col("slot_no").alias("no"), F.col(first_value).alias("v")))
    last = F.coalesce(F.last(there, True).over(wb), F.struct(F.col("left_no").alias("no"), F.col("left_v").alias("v")))
    nxt_v = F.coalesce(
        F.first(there, True).over(wb.rowsBetween(0, Window.unboundedFollowing)),
        F.struct(F.col("right_no").alias("no"), F.col("right_v").alias("v")))
    gap = nxt_v["no"] - last["no"] - 1
    line = last["v"] + (nxt_v["v"] - last["v"]) * (F.col("slot_no") - last["no"]) / F.nullif(nxt_v["no"] - last["no"], F.lit(0))
    filled = F.when(F.col(first_value).isNotNull(), F.col(first_value)).when(gap <= max_gap, line)
    return out.select(*RANGE, "block", "slot_no", *values, "status", filled.alias("filled"))


def _with_neighbours(blocks: DataFrame, seen: DataFrame, value: str) -> DataFrame:
    """Each block of a range with the last non-null reading before it and the first one behind it.
    Works on one row per block, a ``block``-th of the slots."""
    edge = seen.where(F.col(value).isNotNull()).groupBy(*SERIES, "block").agg(
        F.min("slot_no").alias("f_no"), F.min_by(value, "slot_no").alias("f_v"),
        F.max("slot_no").alias("l_no"), F.max_by(value, "slot_no").alias("l_v"))
    j = blocks.join(edge, [*SERIES, "block"], "left")
    w = Window.partitionBy(*RANGE).orderBy("block")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    inside_l = F.when(F.col("l_no") >= F.col("from_no"), F.struct("l_no", "l_v"))
    inside_f = F.when(F.col("f_no") <= F.col("to_no"), F.struct("f_no", "f_v"))
    j = j.withColumn("bl", F.last(inside_l, True).over(before)).withColumn("br", F.first(inside_f, True).over(behind))
    return j.select(
        *RANGE, "block", "lo", "hi", F.col("bl.l_no").alias("left_no"), F.col("bl.l_v").alias("left_v"),
        F.col("br.f_no").alias("right_no"), F.col("br.f_v").alias("right_v"))
