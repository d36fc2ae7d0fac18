"""Implausible readings of bar series: impossible, stuck, and out of line with their own series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.slots import BLOCK, SERIES, readings, step_us
from barloom.plans.materialize import measured_broadcast, written

FIELDS = ("high", "low", "quote_volume")
BAR = ("open", "high", "low", "close", "volume", "quote_volume")
#: Slots either side that make up a bar's level, and slots a stuck run has at least.
REACH, RUN = 10, 5


def _middle(values: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.sort_array(values), F.size(values)
    lo, hi = F.floor((n + 1) / F.lit(2)).cast("int"), F.floor((n + 2) / F.lit(2)).cast("int")
    return F.when(n > 0, (F.element_at(s, lo) + F.element_at(s, hi)) / 2)


def departures(bars: DataFrame, fields: Sequence[str] = FIELDS, reach: int = REACH, run: int = RUN, block: int = BLOCK, signed: bool = False) -> DataFrame:
    """Every reading with the flags that need no comparison across its series: SERIES, slot_no,
    impossible, stuck, and dep_{field}, the absolute log ratio of a positive value to the median of the
    positive values within ``reach`` slots either side. ``signed`` keeps the ratio's sign and adds step_{field}, the log
    ratio to the slot before.

    A block borrows ``reach`` slots from its neighbours, so a series of any length splits into blocks
    and one shuffle with one sort serves all flags.
    """
    r = readings(bars, list(BAR), halo=max(reach, run - 1), block=block)
    r = r.select(*[c for c in r.columns if c not in BAR], *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in BAR])
    w = Window.partitionBy(*SERIES, "block").orderBy("slot_no")
    near = w.rangeBetween(-reach, reach)
    same = (F.lag("slot_no").over(w) == F.col("slot_no") - 1) & (F.col("quote_volume") > 0)
    for f in FIELDS:
        same = same & (F.lag(f).over(w) == F.col(f))
    r = r.withColumn("joins_", F.coalesce(same, F.lit(False)).cast("int"))
    # A run is stuck where `run`-1 joins in a row exist; a bar is in one if such a stretch covers it.
    r = r.withColumn("full_", (F.sum("joins_").over(w.rangeBetween(-(run - 2), 0)) == run - 1).cast("int"))
    stuck = F.coalesce(F.max("full_").over(w.rangeBetween(0, run - 1)) == 1, F.lit(False))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    # A null in one comparison must not hide another that holds.
    parts = [(h < o), (h < c), (h < lo), (lo > o), (lo > c), *(x <= 0 for x in (o, h, lo, c)), (F.col("volume") < 0), (F.col("quote_volume") < 0)]
    impossible = F.lit(False)
    for p in parts:
        impossible = impossible | F.coalesce(p, F.lit(False))
    r = r.withColumn("stuck", stuck).withColumn("impossible", impossible)
    for f in fields:
        good = F.when(F.col(f) > 0, F.col(f))
        r = r.withColumn(f"near_{f}", F.collect_list(good).over(near))
    log = {f: F.ln(F.when(F.col(f) > 0, F.col(f)) / _middle(F.col(f"near_{f}"))) for f in fields}
    deps = [(x if signed else F.abs(x)).alias(f"dep_{f}") for f, x in log.items()]
    if signed:
        adjacent = F.lag("slot_no").over(w) == F.col("slot_no") - 1
        good = lambda c: F.when(c > 0, c)
        deps += [F.when(adjacent, F.ln(good(F.col(f)) / good(F.lag(f).over(w)))).alias(f"step_{f}") for f in fields]
    return r.where("own").select(*SERIES, "slot_no", "impossible", "stuck", *deps)


def hour_of_day() -> Column:
    return F.pmod(F.floor(F.col("slot_no") * step_us(F.col("timeframe")) / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def usual_departures(deps: DataFrame, fields: Sequence[str] = FIELDS, context: str = "series", k: int = 1024) -> DataFrame:
    """Median departure of each field per series, or per series and hour of day (``context='hour'``).

    Quantile sketches are built per series and hour on each partition, merged across partitions and,
    for the series, across hours. Up to about ``k`` values a sketch is exact; beyond, its rank error is
    under half a percent.
    """
    s = deps.groupBy(*SERIES, hour_of_day().alias("hour")).agg(
        *[F.kll_sketch_agg_double(F.col(f"dep_{f}"), F.lit(k)).alias(f"q_{f}") for f in fields])
    keys = [*SERIES, "hour"]
    if context == "series":
        keys = list(SERIES)
        s = s.groupBy(*SERIES).agg(*[F.kll_merge_agg_double(F.col(f"q_{f}"), F.lit(k)).alias(f"q_{f}") for f in fields])
    # A sketch without a value has no quantile.
    med = lambda f: F.when(F.kll_sketch_get_n_double(f"q_{f}") > 0, F.kll_sketch_get_quantile_double(F.col(f"q_{f}"), F.lit(0.5)))
    return s.select(*keys, *[med(f).alias(f"usual_{f}") for f in fields])


def flag_readings(
    bars: DataFrame, limit: float = 18.0, fields: Sequence[str] = FIELDS, context: str = "series", block: int = BLOCK,
) -> DataFrame:
    """Flags (SERIES, slot_no, kind), one row per reading and kind: IMPOSSIBLE, STUCK, SPIKE.

    SPIKE: a field departs from the level around it by more than ``limit`` times the median departure
    of its series (or of the series in that hour of the day, ``context='hour'``). A series whose median
    departure is 0 has no scale and no spikes; nulls are not judged; equal rows and superseded
    deliveries count once; an empty table gives no flags.
    """
    deps = written(departures(bars, fields, block=block), "departures")
    usual = measured_broadcast(written(usual_departures(deps, fields, context), "usual"))
    keys = list(SERIES)
    if context == "hour":
        deps, keys = deps.withColumn("hour", hour_of_day()), [*SERIES, "hour"]
    j = deps.join(usual, keys, "left")
    spike = F.lit(False)
    for f in fields:
        spike = spike | F.coalesce((F.col(f"usual_{f}") > 0) & (F.col(f"dep_{f}") > limit * F.col(f"usual_{f}")), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(F.col("impossible"), "IMPOSSIBLE"), F.when(F.col("stuck"), "STUCK"), F.when(spike, "SPIKE")))
    return j.select(*SERIES, "slot_no", F.explode(kinds).alias("kind"))


def fences(values: DataFrame, names: Sequence[str], expand: float, least: int, k: int = 1024) -> DataFrame:
    """low_ and high_ of each column per series and hour of day: the quartiles, ``expand`` interquartile ranges further
    out, from sketches merged across partitions. NULL where an hour has fewer than ``least`` values or no spread."""
    s = values.groupBy(*SERIES, hour_of_day().alias("hour")).agg(*[F.kll_sketch_agg_double(n, F.lit(k)).alias(f"q_{n}") for n in names])
    out = []
    for n in names:
        at = lambda p, q=f"q_{n}": F.kll_sketch_get_quantile_double(F.col(q), F.lit(p))
        enough = F.kll_sketch_get_n_double(f"q_{n}") >= least
        q1, q3 = F.when(enough, at(0.25)), F.when(enough, at(0.75))
        out += [F.when(q3 > q1, q1 - expand * (q3 - q1)).alias(f"low_{n}"), F.when(q3 > q1, q3 + expand * (q3 - q1)).alias(f"high_{n}")]
    return s.select(*SERIES, "hour", *out)


def fenced_readings(bars: DataFrame, expand: float = 9.0, least: int = 12, fields: Sequence[str] = FIELDS, block: int = BLOCK) -> DataFrame:
    """Flags (SERIES, slot_no, kind) against each source's normal behaviour in that hour of the day: IMPOSSIBLE and STUCK
    as in flag_readings; SPIKE, a field whose log ratio to the level around it lies outside the expanded interquartile
    fences of its series and hour; JUMP, one whose log ratio to the slot before lies outside the fences of such ratios.
    Hours with fewer than ``least`` values, or without spread, have no fences; nulls are not judged."""
    deps = written(departures(bars, fields, block=block, signed=True), "departures")
    names = [f"{k}_{f}" for k in ("dep", "step") for f in fields]
    usual = measured_broadcast(written(fences(deps, names, expand, least), "fences"))
    j = deps.withColumn("hour", hour_of_day()).join(usual, [*SERIES, "hour"], "left")
    out = lambda kind: F.greatest(*[F.coalesce((F.col(f"{kind}_{f}") < F.col(f"low_{kind}_{f}")) | (F.col(f"{kind}_{f}") > F.col(f"high_{kind}_{f}")), F.lit(False)) for f in fields])
    kinds = F.array_compact(F.array(
        F.when(F.col("impossible"), "IMPOSSIBLE"), F.when(F.col("stuck"), "STUCK"), F.when(out("dep"), "SPIKE"), F.when(out("step"), "JUMP")))
    return j.select(*SERIES, "slot_no", F.explode(kinds).alias("kind"))
