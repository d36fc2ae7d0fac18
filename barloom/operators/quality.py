"""Integrity of bar deliveries: duplicates, malformed and impossible bars, gaps, irregular steps, lifecycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.slots import BLOCK, SERIES, micros, step_us
from barloom.sources.tables import require_columns

NEEDED = ("open", "high", "low", "close", "volume", "quote_volume")


def impossible(allow_negative: bool = False) -> Column:
    """High below another price, low above another, or a negative value (unless allowed)."""
    c = F.col
    bad = (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high"))
    if not allow_negative:
        bad = bad | (F.least(*NEEDED) < 0)
    return F.coalesce(bad, F.lit(False))


def time_steps(bars: DataFrame, keys: Sequence[str] = SERIES, time: str = "open_time") -> DataFrame:
    """Distinct times of each series in blocks, with the time before: keys, us, prev_us, step.

    Times are combined before they are shuffled. A block's first time gets its forerunner from one row
    per block, so a long series is no single task's work.
    """
    step = step_us(F.col("timeframe"))
    t = bars.where(F.col(time).isNotNull() & step.isNotNull()).select(*keys, micros(F.col(time)).alias("us"), step.alias("step"))
    t = t.withColumn("block", F.floor(F.col("us") / (F.col("step") * BLOCK)).cast("long"))
    t = t.groupBy(*keys, "step", "block", "us").agg(F.count("*").alias("copies"))
    w = Window.partitionBy(*keys, "step", "block").orderBy("us")
    t = t.withColumn("in_", F.lag("us").over(w))
    edge = t.groupBy(*keys, "step", "block").agg(F.max("us").alias("hi"))
    edge = edge.withColumn("before_", F.lag("hi").over(Window.partitionBy(*keys, "step").orderBy("block"))).drop("hi")
    return t.join(edge, [*keys, "step", "block"]).select(*keys, "step", "us", "copies", F.coalesce("in_", "before_").alias("prev_us"))


def validate(bars: DataFrame, keys: Sequence[str] = SERIES, allow_negative: bool = False) -> DataFrame:
    """Issues per series (keys, code, severity, n): DUPLICATE_TIMESTAMP (all members), MALFORMED_CANDLE (a null
    among prices and volumes), IMPOSSIBLE_OHLC, MISSING_INTERVAL (whole steps missing; may be 0 where a
    step and a half passed) and IRREGULAR_INTERVAL. A series without issues gives no row."""
    require_columns(bars, {*keys, "open_time", *NEEDED})
    null = F.lit(False)
    for c in NEEDED:
        null = null | F.col(c).isNull()
    content = bars.groupBy(*keys).agg(F.count_if(null).alias("malformed"), F.count_if(impossible(allow_negative)).alias("impossible"))
    d = F.col("us") - F.col("prev_us")
    s = F.col("step")
    times = time_steps(bars, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("dup"),
        F.count_if(d > s).alias("gaps"), F.coalesce(F.sum(F.when(d > s, F.floor(d / s) - 1)), F.lit(0)).alias("missing"),
        F.count_if((d < s) | (F.pmod(d, s) != 0)).alias("irregular"))
    row = lambda code, sev, n, there: F.when(there, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), n.cast("long").alias("n")))
    c = F.col
    issues = F.array_compact(F.array(
        row("DUPLICATE_TIMESTAMP", "ERROR", c("dup"), c("dup") > 0), row("MALFORMED_CANDLE", "ERROR", c("malformed"), c("malformed") > 0),
        row("IMPOSSIBLE_OHLC", "ERROR", c("impossible"), c("impossible") > 0), row("MISSING_INTERVAL", "WARN", c("missing"), c("gaps") > 0),
        row("IRREGULAR_INTERVAL", "ERROR", c("irregular"), c("irregular") > 0)))
    return content.join(times, list(keys), "left").select(*keys, F.inline(issues))


def deduplicate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows; those that share ``keys`` but not their content are a conflict and raise an error."""
    d = rows.distinct()
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = d.withColumn("n_", n)
    return checked.where(F.when(F.col("n_") > 1, F.raise_error(F.lit("conflicting duplicates"))).otherwise(F.lit(True))).drop("n_")


def conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ, with the number of versions. Identical repeats are none."""
    h = F.xxhash64(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.countDistinct(h).alias("versions")).where(F.col("versions") > 1)


def lifecycle(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """First and last time, distinct times and whole steps missing in between, per series."""
    d = F.col("us") - F.col("prev_us")
    return time_steps(bars, keys).groupBy(*keys).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("observed"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.floor(d / F.col("step")) - 1)), F.lit(0)).cast("long").alias("missing"))


def off_grid(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Deliveries whose time is off their series' grid: keys, us, off_us."""
    us, step = micros(F.col("open_time")), step_us(F.col("timeframe"))
    return bars.select(*keys, us.alias("us"), F.pmod(us, step).alias("off_us")).where(F.col("off_us") != 0)


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values; a NULL differs from an empty string."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def table_hash(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free hash per ``keys`` (or of the whole table): the sum of 60-bit prefixes of the rows' SHA-256 as a
    decimal, and the number of rows. Combined before it is shuffled; repeated rows count."""
    h = df.select(*keys, F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return h.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("table_hash"))


def archive_summary(bars: DataFrame, key: str = "archive_object") -> DataFrame:
    """Per archive of daily bars: rows, distinct days, sum of quote_volume, issue_codes (DUPLICATE_TIMESTAMP, IMPOSSIBLE_OHLC,
    MISSING_INTERVAL, joined by ;) and PASS or ISSUES. ``bars`` has ``key``, timeframe, open_time and the prices."""
    bad = F.coalesce((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.col("quote_volume") < 0), F.lit(False))
    g = bars.groupBy(key).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("quote_volume"), F.lit(0.0)).alias("quote_volume"), F.max(bad).alias("bad_"))
    t = time_steps(bars, (key,)).groupBy(key).agg(
        F.countDistinct(F.floor(F.col("us") / F.lit(86_400_000_000))).alias("days"), F.max(F.col("copies") > 1).alias("dup_"), F.coalesce(F.max(F.col("us") - F.col("prev_us") > F.col("step")), F.lit(False)).alias("gap_"))
    codes = F.concat_ws(";", F.when(F.col("dup_"), "DUPLICATE_TIMESTAMP"), F.when(F.col("bad_"), "IMPOSSIBLE_OHLC"), F.when(F.col("gap_"), "MISSING_INTERVAL"))
    out = g.join(t, key).withColumn("issue_codes", codes)
    return out.select(key, "rows", "days", "quote_volume", "issue_codes", F.when(F.col("issue_codes") == "", "PASS").otherwise("ISSUES").alias("integrity_status"))


def step_anomalies(bars: DataFrame, month: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows whose distance to the row before them, archives taken month by month, is no positive multiple of the step: keys,
    month, us, prev_us, delta_us, anomaly_type (TIME_REVERSAL, DUPLICATE_TIMESTAMP, OFF_GRID_TIMESTAMP). Within a
    month rows are in order of time; the last time of a month travels to the next one as one row per month."""
    step = step_us(F.col("timeframe"))
    b = bars.where(F.col("open_time").isNotNull() & step.isNotNull()).select(*keys, month, micros(F.col("open_time")).alias("us"), step.alias("step_"))
    w = Window.partitionBy(*keys, month).orderBy("us")
    ends = b.groupBy(*keys, month).agg(F.max("us").alias("hi_"))
    ends = ends.withColumn("before_", F.lag("hi_").over(Window.partitionBy(*keys).orderBy(month))).drop("hi_")
    b = b.withColumn("in_", F.lag("us").over(w)).join(ends, [*keys, month]).withColumn("prev_us", F.coalesce("in_", "before_"))
    d = F.col("us") - F.col("prev_us")
    kind = F.when(d < 0, "TIME_REVERSAL").when(d == 0, "DUPLICATE_TIMESTAMP").when(F.pmod(d, F.col("step_")) != 0, "OFF_GRID_TIMESTAMP")
    return b.select(*keys, month, "us", "prev_us", d.alias("delta_us"), kind.alias("anomaly_type")).where(F.col("anomaly_type").isNotNull())


def quarantined(bars: DataFrame, allowed: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Deliveries with verdict: KEPT on the grid of their series, QUARANTINED off it in a series of ``allowed`` (audited for
    it), NOT_ALLOWED off it elsewhere, which a strict caller treats as an error."""
    off = F.pmod(micros(F.col("open_time")), step_us(F.col("timeframe"))) != 0
    b = bars.join(allowed.select(*keys).distinct().withColumn("allowed_", F.lit(True)), list(keys), "left")
    return b.withColumn("verdict", F.when(~off, "KEPT").when(F.col("allowed_"), "QUARANTINED").otherwise("NOT_ALLOWED")).drop("allowed_")


def completed_cutoff(now: Column, timeframe: Column) -> Column:
    """Epoch microseconds at which the last bar that is complete at ``now`` begins."""
    step = step_us(timeframe)
    return ((F.floor(micros(now) / step) - 1) * step).cast("long")
