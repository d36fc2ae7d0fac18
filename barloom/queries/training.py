"""Queries of the general training-data operators (problems 1, 2, 4, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.grid import RANGE, audited_ranges, regular_grid
from barloom.operators.parsing import failed_lines, loaded_bars, parse_bars
from barloom.operators.rolling import rolling_totals
from barloom.operators.slots import SERIES, slot_no, step_us
from barloom.operators.spikes import fenced_readings, flag_readings
from barloom.operators.timestamps import normalised_times
from barloom.sources.tables import table

MEASURES = ("volume", "quote_volume", "taker_buy_volume")


def _slot_ms() -> Column:
    return (F.col("slot_no") * (step_us(F.col("timeframe")) / 1000)).cast("long").alias("slot_ms")


def _daily_totals(spark: SparkSession, d: str) -> DataFrame:
    daily = F.col("timeframe") == "1d"
    days = regular_grid(
        table(spark, d, "klines").where(daily), table(spark, d, "integrity_summary").where(daily), MEASURES)
    days = days.withColumn("trade_day", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot_no").cast("int")), "yyyy-MM-dd"))
    return rolling_totals(days.select(*RANGE, "slot_no", "trade_day", "status", *MEASURES), RANGE, "slot_no", MEASURES)


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of every audited day, idle days included."""
    t = _daily_totals(spark, d)
    values = [(F.col(c).cast("double") + F.col(c.replace("total_", "rest_"))).alias(c) for c in t.columns if c.startswith("total_")]
    values += [F.col(c) for c in t.columns if c.startswith("avg_")]
    return t.select("market", "symbol", "trade_day", "day_no", "status", *values)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = _daily_totals(spark, d).where(F.col("day_no") >= 30)
    rows = []
    for m in MEASURES:
        week, month, over_w, over_m = (F.col(f"{c}_{m}_{p}") for c in ("total", "rest") for p in (7, 30))
        # Decimals against decimals first, so that rounding decides nothing.
        lead = (week * 10 - month * 6).cast("double") + (over_w * 10 - over_m * 6)
        quiet = (week == 0) & (over_w == 0) & (month.cast("double") + over_m > 0)
        kind = F.when(quiet, "QUIET").when(lead > 0, "SURGE")
        rows.append(F.struct(F.lit(m).alias("measure"), kind.alias("kind")))
    return t.select("market", "symbol", "trade_day", F.inline(F.array(*rows))).where(F.col("kind").isNotNull()).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_lines(parse_bars(table(spark, d, "raw_klines").select("line_id", "raw_line"))).select("line_id", "reason")


def p2_bars(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines, typed."""
    bars = loaded_bars(parse_bars(table(spark, d, "raw_klines").select("line_id", "raw_line")))
    return bars.drop("raw_line").withColumns({
        "open_time": F.unix_micros("open_time"), "close_time": F.unix_micros("close_time")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = normalised_times(table(spark, d, "vendor_klines"), table(spark, d, "dataset_semantics"))
    return t.where(F.col("open_ms").isNotNull() & F.col("close_ms").isNotNull()).select("rec_id", "open_ms", "close_ms").distinct()


def p4_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset, how many times denote an instant and why the others do not."""
    t = normalised_times(table(spark, d, "vendor_klines"), table(spark, d, "dataset_semantics"))
    return t.groupBy("dataset", "open_status", "close_status").agg(F.count("*").alias("records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid(table(spark, d, "klines"), table(spark, d, "integrity_summary"))
    # A series may be audited in ranges that overlap; the marked slots are few.
    return g.where(F.col("status") != "OBSERVED").select(*SERIES, _slot_ms()).distinct()


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row per slot of each audited range, short gaps between closes filled by a straight line."""
    g = regular_grid(table(spark, d, "klines"), table(spark, d, "integrity_summary"), fill="linear")
    return g.select(*SERIES, "from_no", _slot_ms(), "close", "status", F.round("filled", 8).alias("filled"))


def p6_missing(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a close per audited range, next to the count on record."""
    audits = table(spark, d, "integrity_summary")
    g = regular_grid(table(spark, d, "klines"), audits)
    n = g.groupBy(*RANGE).agg(F.count_if(F.col("status") != "OBSERVED").alias("missing_now"), F.count("*").alias("slots"))
    rec = audits.join(audited_ranges(audits).select(*SERIES).distinct(), list(SERIES), "left_semi")
    rec = rec.select(*SERIES, slot_no(F.col("audited_from"), F.col("timeframe")).alias("from_no"),
                     slot_no(F.col("audited_to"), F.col("timeframe")).alias("to_no"), "missing_intervals")
    return n.join(rec, list(RANGE), "left").select(
        *SERIES, "from_no", "slots", "missing_now", F.col("missing_intervals").alias("missing_recorded"),
        (F.col("missing_intervals") == F.col("missing_now")).alias("agrees"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(table(spark, d, "klines")).select(*SERIES, _slot_ms(), "kind")


def p7_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Readings outside the expanded interquartile fences of their series in that hour of the day, or that moved from
    the slot before beyond those of the series' moves in that hour, beside impossible and stuck ones."""
    return fenced_readings(table(spark, d, "klines")).select(*SERIES, _slot_ms(), "kind")


def p7_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Impossible readings within each audited range, next to the verdict on record."""
    audits = table(spark, d, "integrity_summary")
    flags = flag_readings(table(spark, d, "klines")).where(F.col("kind") == "IMPOSSIBLE")
    r = audited_ranges(audits)
    hits = flags.join(r, list(SERIES)).where(F.col("slot_no").between(F.col("from_no"), F.col("to_no")))
    n = hits.groupBy(*RANGE).agg(F.count("*").alias("impossible"))
    rec = audits.select(*SERIES, slot_no(F.col("audited_from"), F.col("timeframe")).alias("from_no"),
                        slot_no(F.col("audited_to"), F.col("timeframe")).alias("to_no"), "ohlc_invariant")
    return rec.join(n, list(RANGE), "left").select(
        *SERIES, "from_no", F.coalesce("impossible", F.lit(0)).cast("long").alias("impossible"),
        F.col("ohlc_invariant").alias("recorded"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_totals, p2_found, p2_bars, p4_found, p4_unreadable, p6_found, p6_grid, p6_missing, p7_found, p7_hourly, p7_invariant)}

_READ = """
steps AS (SELECT *, CASE timeframe WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 ELSE 86400 END * 1000000::BIGINT AS st FROM klines),
slotted AS (SELECT *, CASE WHEN timeframe = '1d' THEN epoch_us(open_time) // st ELSE (epoch_us(open_time) + st // 2) // st END AS slot_no FROM steps),
reading AS (SELECT * FROM slotted QUALIFY row_number() OVER (PARTITION BY market, symbol, timeframe, slot_no ORDER BY ingested_at DESC NULLS LAST) = 1),
spans AS (SELECT *, st, CASE WHEN timeframe = '1d' THEN epoch_us(audited_from) // st ELSE (epoch_us(audited_from) + st // 2) // st END AS from_no,
  CASE WHEN timeframe = '1d' THEN epoch_us(audited_to) // st ELSE (epoch_us(audited_to) + st // 2) // st END AS to_no
  FROM (SELECT *, CASE timeframe WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 ELSE 86400 END * 1000000::BIGINT AS st FROM integrity_summary)),
grid AS (SELECT market, symbol, timeframe, st, from_no, to_no, missing_intervals, unnest(range(from_no, to_no + 1)) AS slot_no FROM spans)
"""

_DAYS = f"""
WITH {_READ},
days AS (SELECT g.market, g.symbol, g.from_no, g.slot_no, m.measure,
  coalesce(CASE m.measure WHEN 'volume' THEN r.volume WHEN 'quote_volume' THEN r.quote_volume ELSE r.taker_buy_volume END, 0)::DECIMAL(30,9) AS v
  FROM grid g CROSS JOIN (VALUES ('volume'), ('quote_volume'), ('taker_buy_volume')) m(measure)
  LEFT JOIN reading r ON r.market = g.market AND r.symbol = g.symbol AND r.timeframe = '1d' AND r.slot_no = g.slot_no
  WHERE g.timeframe = '1d'),
sums AS (SELECT *, row_number() OVER (PARTITION BY market, symbol, from_no, measure ORDER BY slot_no) AS day_no,
  sum(v) OVER (PARTITION BY market, symbol, from_no, measure ORDER BY slot_no ROWS 6 PRECEDING) AS w7,
  sum(v) OVER (PARTITION BY market, symbol, from_no, measure ORDER BY slot_no ROWS 29 PRECEDING) AS w30 FROM days)
"""

_JUDGED = r"""
WITH lines AS (SELECT line_id, regexp_replace(raw_line, '\r$', '') AS l FROM raw_klines),
kept AS (SELECT * FROM lines WHERE NOT regexp_matches(l, '^\x{FEFF}?"?open_time"?(,|$)')),
quoted AS (SELECT *, regexp_full_match(l, '("(?:[^"]|"")*"|[^",]*)(,("(?:[^"]|"")*"|[^",]*))*') AS ok FROM kept),
parts AS (SELECT *, list_transform(regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS f FROM quoted),
typed AS (SELECT *,
  [x[1] for x in [1]] AS ignored_,
  CASE WHEN regexp_full_match(f[1], '\+?([0-9]{13}|[0-9]{16})') THEN f[1]::BIGINT * (CASE WHEN length(ltrim(f[1], '+')) = 13 THEN 1000 ELSE 1 END) END AS o,
  CASE WHEN regexp_full_match(f[7], '\+?([0-9]{13}|[0-9]{16})') THEN f[7]::BIGINT * (CASE WHEN length(ltrim(f[7], '+')) = 13 THEN 1000 ELSE 1 END) END AS c,
  list_transform([f[2], f[3], f[4], f[5], f[6], f[8], f[10], f[11]], lambda x: CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(ltrim(x, '+') AS DOUBLE) END) AS n,
  CASE WHEN regexp_full_match(f[9], '[+-]?[0-9]+') THEN try_cast(ltrim(f[9], '+') AS BIGINT) END AS k FROM parts),
judged AS (SELECT *, CASE WHEN NOT ok THEN 'BROKEN_QUOTING' WHEN l IS NULL OR len(f) <> 12 THEN 'COLUMN_COUNT'
  WHEN coalesce(o, -1) < 0 OR c IS NULL OR c <= o OR coalesce(k, -1) < 0
    OR len(list_filter(n[1:4], lambda x: x > 0 AND x < 'inf'::DOUBLE)) < 4 OR len(list_filter(n[5:8], lambda x: x >= 0 AND x < 'inf'::DOUBLE)) < 4 THEN 'INVALID_VALUE' END AS reason FROM typed)
""".replace("  [x[1] for x in [1]] AS ignored_,\n", "")

SQL = {
    "p1_found": _DAYS + """
SELECT DISTINCT market, symbol, strftime(DATE '1970-01-01' + slot_no::INT, '%Y-%m-%d') AS trade_day, measure,
  CASE WHEN w7 = 0 AND w30 > 0 THEN 'QUIET' WHEN w7 * 10 > w30 * 6 THEN 'SURGE' END AS kind
FROM sums WHERE day_no >= 30 AND ((w7 = 0 AND w30 > 0) OR w7 * 10 > w30 * 6)""",
    "p2_found": _JUDGED + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_bars": _JUDGED + """SELECT line_id, o AS open_time, c AS close_time, n[1] AS open, n[2] AS high, n[3] AS low, n[4] AS close, n[5] AS volume,
  n[6] AS quote_volume, k AS trade_count, n[7] AS taker_buy_volume, n[8] AS taker_buy_quote_volume FROM judged WHERE reason IS NULL""",
    "p6_found": f"""WITH {_READ}
SELECT DISTINCT g.market, g.symbol, g.timeframe, g.slot_no * g.st // 1000 AS slot_ms FROM grid g
LEFT JOIN reading r ON r.market = g.market AND r.symbol = g.symbol AND r.timeframe = g.timeframe AND r.slot_no = g.slot_no
WHERE r.close IS NULL""",
    "p6_missing": f"""WITH {_READ},
j AS (SELECT g.*, r.close FROM grid g LEFT JOIN reading r ON r.market = g.market AND r.symbol = g.symbol AND r.timeframe = g.timeframe AND r.slot_no = g.slot_no)
SELECT market, symbol, timeframe, from_no, count(*) AS slots, count(*) FILTER (close IS NULL) AS missing_now, any_value(missing_intervals) AS missing_recorded,
  any_value(missing_intervals) = count(*) FILTER (close IS NULL) AS agrees FROM j GROUP BY market, symbol, timeframe, from_no, to_no""",
    "p1_totals": _DAYS + """, wide AS (SELECT market, symbol, from_no, slot_no, any_value(day_no) AS day_no, """ + ", ".join(
        f"sum(w{p}) FILTER (measure = '{m}')::DOUBLE AS total_{m}_{p}, (sum(w{p}) FILTER (measure = '{m}'))::DOUBLE / least(any_value(day_no), {p}) AS avg_{m}_{p}" for m in MEASURES for p in (7, 30)) + """ FROM sums GROUP BY ALL)
SELECT g.market, g.symbol, strftime(DATE '1970-01-01' + g.slot_no::INT, '%Y-%m-%d') AS trade_day, g.day_no, """ + ", ".join(f"{k}_{m}_{p}" for k in ("total", "avg") for m in MEASURES for p in (7, 30)) + """, CASE WHEN r.volume IS NOT NULL THEN 'OBSERVED' WHEN r.slot_no IS NOT NULL THEN 'NULL_VALUE' ELSE 'MISSING' END AS status FROM wide g
LEFT JOIN reading r ON r.market = g.market AND r.symbol = g.symbol AND r.timeframe = '1d' AND r.slot_no = g.slot_no""",
    "p7_invariant": f"""WITH {_READ}, bad AS (SELECT market, symbol, timeframe, slot_no FROM reading WHERE high < open OR high < close OR high < low OR low > open OR low > close OR least(open, high, low, close) <= 0 OR volume < 0 OR quote_volume < 0)
SELECT s.market, s.symbol, s.timeframe, s.from_no, count(b.slot_no) AS impossible, any_value(s.ohlc_invariant) AS recorded FROM spans s
LEFT JOIN bad b ON b.market = s.market AND b.symbol = s.symbol AND b.timeframe = s.timeframe AND b.slot_no BETWEEN s.from_no AND s.to_no GROUP BY s.market, s.symbol, s.timeframe, s.from_no, s.to_no""",
    "p7_found": f"""WITH {_READ},
pos AS (SELECT *, CASE WHEN high > 0 THEN high END AS h, CASE WHEN low > 0 THEN low END AS l, CASE WHEN quote_volume > 0 THEN quote_volume END AS q FROM reading),
lev AS (SELECT *, median(h) OVER near AS mh, median(l) OVER near AS ml, median(q) OVER near AS mq,
  coalesce((lag(slot_no) OVER s = slot_no - 1 AND lag(high) OVER s = high AND lag(low) OVER s = low AND lag(quote_volume) OVER s = quote_volume AND quote_volume > 0)::INT, 0) AS joined
  FROM pos WINDOW s AS (PARTITION BY market, symbol, timeframe ORDER BY slot_no), near AS (PARTITION BY market, symbol, timeframe ORDER BY slot_no RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
dep AS (SELECT *, abs(ln(h / mh)) AS dh, abs(ln(l / ml)) AS dl, abs(ln(q / mq)) AS dq,
  slot_no - sum(joined) OVER (PARTITION BY market, symbol, timeframe ORDER BY slot_no) AS dummy,
  sum(1 - joined) OVER (PARTITION BY market, symbol, timeframe ORDER BY slot_no) AS run FROM lev),
runs AS (SELECT *, count(*) OVER (PARTITION BY market, symbol, timeframe, run) AS run_n FROM dep),
usual AS (SELECT market, symbol, timeframe, median(dh) AS uh, median(dl) AS ul, median(dq) AS uq FROM dep GROUP BY 1, 2, 3),
flagged AS (SELECT d.*, unnest([CASE WHEN high < open OR high < close OR high < low THEN 'IMPOSSIBLE' WHEN low > open OR low > close THEN 'IMPOSSIBLE'
    WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR volume < 0 OR quote_volume < 0 THEN 'IMPOSSIBLE' END,
  CASE WHEN run_n >= 5 THEN 'STUCK' END,
  CASE WHEN (uh > 0 AND dh > 18 * uh) OR (ul > 0 AND dl > 18 * ul) OR (uq > 0 AND dq > 18 * uq) THEN 'SPIKE' END]) AS kind
  FROM runs d JOIN usual USING (market, symbol, timeframe))
SELECT market, symbol, timeframe, slot_no * st // 1000 AS slot_ms, kind FROM flagged WHERE kind IS NOT NULL""",
}
