"""Point-in-time joins: as-of, strictly earlier, several sources at once, and events crossed by an interval."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import zscore
from barloom.operators.ranks import running
from barloom.sources.tables import require_columns


@dataclass(frozen=True)
class Source:
    """Observations that become known at ``time``; ``max_age_us`` makes older ones stale."""

    frame: DataFrame
    time: str
    values: tuple[str, ...]
    max_age_us: int | None = None
    tie: tuple[str, ...] = ()
    base_status: str = "AVAILABLE"


def _us(df: DataFrame, c: str) -> Column:
    """A time as epoch microseconds; a long is taken as such already."""
    return F.col(c) if dict(df.dtypes)[c] in ("bigint", "long") else F.unix_micros(F.col(c).cast("timestamp"))


def asof(
    left: DataFrame, time: str, sources: dict[str, Source], keys: Sequence[str], strict: bool = False, span_us: int = 30 * 86_400_000_000,
) -> DataFrame:
    """``left`` with, per source, the latest observation not after ``time`` (``strict``: before it):
    {source}_{value}, {source}_source_us, {source}_age_us and {source}_coverage (the source's base status;
    NO_PRIOR_OBSERVATION; STALE, where values are NULL but source time and age stay).

    All sources share one union, one shuffle and one sort. Of observations equal in time the last by the
    source's ``tie`` columns counts. A NULL value of the matching observation stays NULL. Keys are cut into
    spans of time; the last observations of each span travel on as one row per span and source, so a key
    with a third of all rows is many tasks' work. Rows with a NULL key or time match nothing.
    """
    require_columns(left, {*keys, time})
    names = list(sources)
    carried = F.struct(*left.columns)
    at = _us(left, time)
    typed = {n: F.struct(*[F.col(v).alias(v) for v in s.values]) for n, s in sources.items()}
    schemas = {n: s.frame.select(typed[n].alias("x")).schema["x"].dataType for n, s in sources.items()}
    null_obs = lambda n: F.lit(None).cast("struct<us:bigint,v:" + schemas[n].simpleString() + ">")
    rank = -1 if strict else 1  # on equal times a strict join puts left rows first
    parts = [left.select(
        *keys, at.alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast("string").alias("tie_"), carried.alias("row_"),
        *[null_obs(n).alias(f"o_{n}") for n in names])]
    row_type = left.select(carried.alias("r")).schema["r"].dataType.simpleString()
    for n, s in sources.items():
        require_columns(s.frame, {*keys, s.time, *s.values, *s.tie})
        t = _us(s.frame, s.time)
        tie = F.concat_ws("\x1f", *[F.lpad(F.col(c).cast("string"), 24, "0") for c in s.tie]) if s.tie else F.lit("")
        f = s.frame.where(t.isNotNull()).select(
            *keys, t.alias("t_"), F.lit(-rank).alias("side_"), tie.alias("tie_"), F.lit(None).cast(row_type).alias("row_"),
            *[(F.struct(t.alias("us"), typed[n].alias("v")) if m == n else null_obs(m)).alias(f"o_{m}") for m in names])
        parts.append(f)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("span_", F.floor(F.col("t_") / F.lit(span_us)))
    w = Window.partitionBy(*keys, "span_").orderBy("t_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    u = u.select(*keys, "span_", "t_", "row_", *[F.last(f"o_{n}", True).over(w).alias(f"o_{n}") for n in names])
    # What a span ends with, carried into later spans: one row per key and span.
    ends = u.groupBy(*keys, "span_").agg(*[F.max_by(f"o_{n}", F.struct("t_", F.col(f"o_{n}.us"))).alias(f"e_{n}") for n in names])
    ws = Window.partitionBy(*keys).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"k_{k}") for k in (*keys, "span_")], *[F.last(f"e_{n}", True).over(ws).alias(f"c_{n}") for n in names])
    null_safe = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in (*keys, "span_")]
    j = u.where(F.col("row_").isNotNull()).join(ends, null_safe, "left").select(
        "t_", "row_", *[F.coalesce(f"o_{n}", f"c_{n}").alias(f"o_{n}") for n in names])
    out = []
    for n, s in sources.items():
        o = F.col(f"o_{n}")
        age = F.col("t_") - o["us"]
        stale = F.coalesce(age > s.max_age_us, F.lit(False)) if s.max_age_us is not None else F.lit(False)
        out += [F.when(~stale, o["v"][v]).alias(f"{n}_{v}") for v in s.values]
        out += [o["us"].alias(f"{n}_source_us"), age.alias(f"{n}_age_us"),
                F.when(o.isNull(), "NO_PRIOR_OBSERVATION").when(stale, "STALE").otherwise(s.base_status).alias(f"{n}_coverage")]
    return j.select("row_.*", *out)


def crossed_events(
    positions: DataFrame, events: DataFrame, entry: str, exit: str, side: str, time: str, rate: str, keys: Sequence[str],
    span_us: int = 30 * 86_400_000_000,
) -> DataFrame:
    """``positions`` with the events of their key in (entry, exit]: crossed (count), rate_sum, cashflow
    (-side x rate_sum), 0 where none is crossed.

    No range join: running sums over the events are taken as of exit less as of entry. The sums run per span
    of time first and across spans on one row per span.
    """
    t = _us(events, time)
    e = events.select(*keys, t.alias("us_"), F.coalesce(F.col(rate).cast("double"), F.lit(0.0)).alias("r_")).where(t.isNotNull())
    e = e.groupBy(*keys, "us_").agg(F.sum("r_").alias("r_"), F.count("*").alias("n_"))
    e = e.withColumn("span_", F.floor(F.col("us_") / F.lit(span_us)))
    w = Window.partitionBy(*keys, "span_").orderBy("us_").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, "span_", "us_", F.sum("r_").over(w).alias("r_"), F.sum("n_").over(w).alias("n_"))
    ends = e.groupBy(*keys, "span_").agg(F.max_by("r_", "us_").alias("r"), F.max("n_").alias("n"))
    ws = Window.partitionBy(*keys).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "span_", F.coalesce(F.sum("r").over(ws), F.lit(0.0)).alias("br_"), F.coalesce(F.sum("n").over(ws), F.lit(0)).alias("bn_"))
    run = e.join(ends, [*keys, "span_"]).select(*keys, "us_", (F.col("r_") + F.col("br_")).alias("r"), (F.col("n_") + F.col("bn_")).alias("n"))
    src = {"sum": Source(run, "us_", ("r", "n"))}
    a = asof(positions, entry, src, keys, span_us=span_us)
    a = a.withColumnsRenamed({"sum_r": "in_r_", "sum_n": "in_n_"}).drop("sum_source_us", "sum_age_us", "sum_coverage")
    b = asof(a, exit, src, keys, span_us=span_us)
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    n, r = z("sum_n", 0) - z("in_n_", 0), z("sum_r", 0.0) - z("in_r_", 0.0)
    return b.select(*positions.columns, n.alias("crossed"), r.alias("rate_sum"), (-F.col(side) * r).alias("cashflow"))


def event_zscore(events: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 90, size: int = 16_384) -> DataFrame:
    """``events`` with zscore: the value's distance from the mean of the last ``n`` events of its key (not bars), in their
    deviations; NULL for the first n - 1. Keys are cut into chunks of positions that borrow n - 1 events, so a key
    with a third of all rows is many tasks' work. Events need a value and differ in ``order``."""
    e = events.where(F.col(value).isNotNull()).withColumn("order_", F.struct(*order))
    at = running(e, keys, "order_").select(*keys, "order_", F.col("below").alias("pos_"))
    e = e.join(at, [*keys, "order_"])
    home = F.floor(F.col("pos_") / F.lit(size)).cast("long")
    e = e.withColumn("chunk_", F.explode(F.sequence(home, F.floor((F.col("pos_") + n - 1) / F.lit(size)).cast("long")))).withColumn("own_", F.col("chunk_") == home)
    w = Window.partitionBy(*keys, "chunk_").orderBy("pos_")
    return e.withColumn("zscore", zscore(F.col(value), w, n)).where("own_").drop("order_", "pos_", "chunk_", "own_")


def month_context(members: DataFrame, objects: DataFrame, keys: Sequence[str], month: str, object_month: str, before: int = 2) -> DataFrame:
    """``objects`` of the months from ``before`` months ahead of a membership up to it, once each, with row_class:
    RESEARCH_ELIGIBLE in a membership's own month, else WARMUP_CONTEXT_ONLY. Months are YYYY-MM; the range join is an
    equality join over the few months of each membership."""
    first = F.to_date(F.concat(F.col(month), F.lit("-01")))
    m = members.select(*keys, F.explode(F.array(*[F.struct(F.date_format(F.add_months(first, -k), "yyyy-MM").alias("m"), F.lit(k == 0).alias("own")) for k in range(before + 1)])).alias("x_"))
    m = m.groupBy(*keys, F.col("x_.m").alias(object_month)).agg(F.max("x_.own").alias("own_"))
    j = objects.join(m, [*keys, object_month])
    return j.withColumn("row_class", F.when(F.col("own_"), "RESEARCH_ELIGIBLE").otherwise("WARMUP_CONTEXT_ONLY")).drop("own_")


def positions(df: DataFrame, keys: Sequence[str], order: str, name: str = "at") -> DataFrame:
    """Adds the position from 0 of a row among those of its key; ``order`` is unique within a key."""
    return df.join(running(df, keys, order).select(*keys, order, F.col("below").alias(name)), [*keys, order])
