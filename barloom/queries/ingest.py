"""Queries of normalisation and of bars built from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import normalize
from barloom.operators.parsing import parse_bars
from barloom.queries.training import _JUDGED
from barloom.sources.tables import table
from barloom.streaming.capture import bars_from_trades, routed


def _epochs(spark, d):
    p = parse_bars(table(spark, d, "raw_klines").select("archive_object", "raw_line")).where(F.col("parsed.status") == "BAR")
    return p.select("archive_object", F.trim(F.regexp_replace(F.substring_index("raw_line", ",", 1), '[" +]', "")).alias("epoch"))


def nrm_unit(spark, d):
    """Unit of the epochs of each archive object."""
    return normalize.units_by(_epochs(spark, d), ["archive_object"], "epoch")


def nrm_ts(spark, d):
    """First and last instant of each archive object, every epoch read in its own unit: objects mix them."""
    n = F.col("epoch").cast("long")
    us = normalize.epoch_micros(n, normalize.epoch_unit(n.cast("double")))
    return _epochs(spark, d).groupBy("archive_object").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def nrm_klines(spark, d):
    """Lines of each archive object by what became of them."""
    p = parse_bars(table(spark, d, "raw_klines").select("archive_object", "raw_line"))
    return p.groupBy("archive_object").agg(*[F.count_if(F.col("parsed.status") == s).alias(s.lower()) for s in ("BAR", "HEADER", "FAIL")])


def nrm_archive(spark, d):
    """Archive lines cut by position, those without a numeric time left out, per market."""
    r = table(spark, d, "raw_klines").select("market", F.split("raw_line", ",").alias("fields"))
    n = normalize.positional(r, "klines")
    return n.groupBy("market").agg(F.count("*").alias("rows"), F.count(F.col("close").try_cast("double")).alias("closes"))


def js_route(spark, d):
    """Events routed by their JSON payload, nested or flat, per market and symbol."""
    p = table(spark, d, "panel")
    kind = F.when(F.col("market") == "um", "1").when(F.col("market") == "cm", "2")
    nested = F.to_json(F.struct(F.struct(F.col("symbol").alias("s")).alias("o"), kind.alias("st")))
    flat = F.to_json(F.struct(F.col("symbol").alias("s"), F.col("market").alias("market_type")))
    e = p.select(F.when(F.col("panel_id") % 2 == 0, nested).otherwise(flat).alias("payload"))
    return routed(e).groupBy("market", "symbol").agg(F.count("*").alias("n"))


def rs_trades(spark, d):
    """Hourly bars of every event type's values."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = bars_from_trades(e, ["event_type"], "ts", "value", "value", "1 hour")
    return b.select("event_type", F.unix_micros("open_time").alias("open_us"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")], "trade_count")


QUERIES = {f.__name__: f for f in (nrm_unit, nrm_ts, nrm_klines, nrm_archive, js_route, rs_trades)}

_OBJ = _JUDGED + ", e AS (SELECT r.archive_object, f[1] AS epoch, CASE WHEN length(ltrim(f[1], '+')) = 13 THEN 'ms' ELSE 'us' END AS u, o FROM judged j JOIN raw_klines r USING (line_id) WHERE reason IS NULL)"
SQL = {
    "nrm_unit": _OBJ + ", g AS (SELECT archive_object, min(abs(ltrim(epoch, '+')::DOUBLE)) AS smallest, count(*) AS n FROM e GROUP BY 1) SELECT *, CASE WHEN smallest >= 1e17 THEN 'ns' WHEN smallest >= 1e14 THEN 'us' WHEN smallest >= 1e11 THEN 'ms' WHEN smallest >= 1e8 THEN 's' END AS unit FROM g",
    "nrm_ts": _OBJ + " SELECT archive_object, min(o) AS first_us, max(o) AS last_us FROM e GROUP BY 1",
    "nrm_klines": _JUDGED + """SELECT r.archive_object, count(*) FILTER (j.line_id IS NOT NULL AND reason IS NULL) AS bar, count(*) FILTER (j.line_id IS NULL) AS header, count(*) FILTER (reason IS NOT NULL) AS fail
FROM raw_klines r LEFT JOIN judged j USING (line_id) GROUP BY 1""",
    "nrm_archive": "SELECT market, count(*) AS rows, count(try_cast(string_split(raw_line, ',')[5] AS DOUBLE)) AS closes FROM raw_klines WHERE try_cast(string_split(raw_line, ',')[1] AS DOUBLE) IS NOT NULL GROUP BY 1",
    "js_route": "SELECT CASE WHEN market IN ('um', 'cm') OR panel_id % 2 = 1 THEN market ELSE 'unknown' END AS market, symbol, count(*) AS n FROM panel GROUP BY ALL",
    "rs_trades": """SELECT event_type, epoch_us(date_trunc('hour', ts)) AS open_us, round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, ts), 6) AS close,
  round(sum(value), 6) AS volume, count(*) AS trade_count FROM events GROUP BY event_type, date_trunc('hour', ts)""",
}
