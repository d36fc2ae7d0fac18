"""Queries of resampling, integrity, joins and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.exprs import number, sdiv
from barloom.operators import cohorts, joins, quality, resample
from barloom.operators.indicators import indicators
from barloom.operators.parsing import loaded_bars, parse_bars
from barloom.operators.segments import clean_bars, segmented
from barloom.operators.slots import SERIES, micros, readings, step_us
from barloom.queries.bars import BARS_SQL, _ema, _E, above_average, bars
from barloom.queries.training import _JUDGED, _READ
from barloom.sources.tables import table

HOUR, DAY = 3_600_000_000, 86_400_000_000
ENTITY = ("market", "symbol")
FIELDS = ("open", "high", "low", "close", *resample.SUMS)


def _resampled(spark: SparkSession, d: str, target: int) -> DataFrame:
    return resample.resample(bars(spark, d), target)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rs_strict(spark, d):
    """Complete hours of every finer series."""
    return _shown(_resampled(spark, d, HOUR))


def rs_contig(spark, d):
    """Hours of every series by runs without gaps, hourly series included."""
    return _shown(resample.resample_contiguous(bars(spark, d), HOUR))


def rs_dedup_contig(spark, d):
    """The same over deliveries on the grid, identical repeats collapsed and slots in conflict left out."""
    k = table(spark, d, "klines").where(F.pmod(micros(F.col("open_time")), step_us(F.col("timeframe"))) == 0)
    k = k.select(*SERIES, "open_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_volume")
    clash = quality.conflicts(k, (*SERIES, "open_time")).drop("versions")
    k = quality.deduplicate(k.join(clash, [*SERIES, "open_time"], "left_anti"), (*SERIES, "open_time")).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    return _shown(resample.resample_contiguous(segmented(clean_bars(k, ["quote_volume", "trade_count", "taker_buy_volume"])), HOUR))


TARGETS = {"1h": HOUR, "4h": 4 * HOUR, "1d": DAY}
COMPARED = (*ENTITY, "source", "target")


def qa_tf_compare(spark, d):
    """Bars of every finer timeframe built up to hours, four hours and days against native bars of the same symbol."""
    b, r = bars(spark, d), None
    for name, us in TARGETS.items():
        x = resample.resample(b, us).withColumnRenamed("timeframe", "source").withColumn("target", F.lit(name))
        r = x if r is None else r.unionByName(x)
    n = b.withColumnsRenamed({"slot_no": "bucket", "timeframe": "target"}).select(*ENTITY, "target", "bucket", *FIELDS)
    sources = F.explode(F.array(*[F.lit(t) for t in ("1m", "15m", "1h", "4h")])).alias("source")
    c = resample.compare_native(r, n.select("*", sources), (*COMPARED, "bucket"), FIELDS)
    return c.withColumn("max_abs_diff", F.round("max_abs_diff", 4))


def qa_tf_driver(spark, d):
    """Fields compared and mismatched per source and target timeframe over all symbols."""
    return qa_tf_compare(spark, d).groupBy("source", "target", "field").agg(F.sum("compared").alias("compared"), F.sum("mismatch_count").alias("mismatch_count"))


def qa_tf_policy(spark, d):
    return resample.source_policy(qa_tf_compare(spark, d), COMPARED)


def qa_validate(spark, d):
    return quality.validate(table(spark, d, "klines"))


BAR = ("open", "high", "low", "close", "volume", "quote_volume")


def qa_dedup(spark, d):
    """Per series: slots in conflict, delivered in versions that differ, and rows that are left of the others once identical
    repeats are collapsed."""
    k = table(spark, d, "klines").select(*SERIES, "open_time", *BAR)
    clash = quality.conflicts(k, (*SERIES, "open_time"))
    kept = quality.deduplicate(k.join(clash, [*SERIES, "open_time"], "left_anti"), (*SERIES, "open_time"))
    n = clash.groupBy(*SERIES).agg(F.count("*").alias("conflicts"))
    out = kept.groupBy(*SERIES).agg(F.count("*").alias("kept")).join(n, list(SERIES), "full")
    return out.select(*SERIES, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "conflicts")])


def _archived(spark, d):
    """Valid archive lines as typed bars with the month of their object."""
    r = table(spark, d, "raw_klines").select(*SERIES, "archive_object", "raw_line")
    b = loaded_bars(parse_bars(r)).drop("raw_line")
    return b.withColumn("archive_month", F.regexp_extract("archive_object", r"-([0-9]{4}-[0-9]{2})\.[a-z]+$", 1))


def qa_1d(spark, d):
    """Daily archives in figures: rows, days, quote volume and issue codes."""
    return _shown(quality.archive_summary(_archived(spark, d).where(F.col("timeframe") == "1d")))


def qa_scan(spark, d):
    """Archive objects by whether all their lines can be read."""
    p = parse_bars(table(spark, d, "raw_klines").select("archive_object", "raw_line"))
    o = p.groupBy("archive_object").agg(F.count_if(F.col("parsed.status") == "FAIL").alias("bad_lines"))
    return o.groupBy(F.when(F.col("bad_lines") > 0, "BAD").otherwise("GOOD").alias("status")).agg(F.count("*").alias("objects"), F.sum("bad_lines").alias("bad_lines"))


def qa_inspect(spark, d):
    """Per object: lines, headers, fields of the widest line and an order-free hash of its lines."""
    r = table(spark, d, "raw_klines")
    h = quality.table_hash(r, ["line_no", "raw_line"], ["archive_object"])
    header = F.col("raw_line").rlike(r'^\x{FEFF}?"?open_time')
    g = r.groupBy("archive_object").agg(F.count_if(header).alias("headers"), F.max(F.size(F.split("raw_line", ","))).alias("columns"))
    return h.join(g, "archive_object")


def qa_offgrid_audit(spark, d):
    """Archive rows that are no positive multiple of the step behind the row before them, across months."""
    return quality.step_anomalies(_archived(spark, d), "archive_month")


def qa_lifecycle_rec(spark, d):
    """Lifecycles with what evidence there is of listing and delisting: none in these tables."""
    life = quality.lifecycle(table(spark, d, "klines"))
    return life.select("*", *[F.lit("UNKNOWN").alias(c) for c in ("listing_evidence", "delisting_evidence")])


def qa_lifecycle(spark, d):
    return quality.lifecycle(table(spark, d, "klines"))


def qa_hash(spark, d):
    """Order-free hash of each market's funding events."""
    f = table(spark, d, "funding_events")
    return quality.table_hash(f, ["funding_id", "symbol", "funding_interval_hours"], ["market"])


def _funding(spark, d, tie=("funding_id",), max_age=None):
    f = table(spark, d, "funding_events").where(F.col("funding_rate").isNotNull())
    return joins.Source(f, "timestamp", ("funding_rate", "funding_id"), max_age, tie)


def _panel(spark, d):
    p = table(spark, d, "panel").select("panel_id", *ENTITY, "timestamp").distinct()
    return p.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp"))).drop("timestamp")


def _asof(spark, d, strict=False, max_age=None):
    a = joins.asof(_panel(spark, d), "us", {"funding": _funding(spark, d, max_age=max_age)}, ENTITY, strict)
    return a.drop("us")


def jn_asof(spark, d):
    """Panel rows with the last funding event up to them; older than 8 hours is stale."""
    return _asof(spark, d, max_age=8 * HOUR)


def jn_asof_event(spark, d):
    return _asof(spark, d).drop("funding_coverage")


def jn_asof_strict(spark, d):
    return _asof(spark, d, strict=True)


def jn_panel(spark, d):
    """Panel rows with funding and with the last hourly bar closed by then, in one pass."""
    closed = bars(spark, d).where(F.col("timeframe") == "1h").select(*ENTITY, "close", ((F.col("slot_no") + 1) * HOUR).alias("closed_us"))
    src = {"funding": _funding(spark, d), "hour": joins.Source(closed, "closed_us", ("close",), 2 * HOUR)}
    return joins.asof(_panel(spark, d), "us", src, ENTITY).drop("us", "funding_source_us", "hour_source_us")


def jn_interval(spark, d):
    """Funding crossed by eight hours behind each panel row, held long in um and short elsewhere."""
    p = _panel(spark, d).withColumn("exit_us", F.col("us") + 8 * HOUR).withColumn("side", F.when(F.col("market") == "um", 1).otherwise(-1))
    x = joins.crossed_events(p, table(spark, d, "funding_events").where(F.col("funding_rate").isNotNull()), "us", "exit_us", "side", "timestamp", "funding_rate", ENTITY)
    return x.select("panel_id", "crossed", (F.round("rate_sum", 9) + F.lit(0.0)).alias("rate_sum"), (F.round("cashflow", 9) + F.lit(0.0)).alias("cashflow"))


def _scored(spark, d):
    return joins.event_zscore(table(spark, d, "funding_events"), ENTITY, ("timestamp", "funding_id"), "funding_rate")


def ft_funding_event_z(spark, d):
    """Funding rates in deviations of the last 90 events (not bars) of their entity."""
    return _scored(spark, d).select("funding_id", (F.round("zscore", 5) + F.lit(0.0)).alias("funding_zscore90"))


def jn_funding(spark, d):
    """Panel rows with the last funding event's rate and z-score, and whether their entity has events at all."""
    src = {"funding": joins.Source(_scored(spark, d), "timestamp", ("funding_rate", "zscore"), None, ("funding_id",))}
    a = joins.asof(_panel(spark, d), "us", src, ENTITY)
    known = table(spark, d, "funding_events").where(F.col("funding_rate").isNotNull()).select(*ENTITY).distinct().withColumn("known_", F.lit(True))
    status = F.when(F.col("known_").isNull(), "HISTORICAL_UNAVAILABLE").when(F.col("funding_funding_rate").isNull(), "NO_PRIOR_EVENT").otherwise("AVAILABLE")
    return a.join(known, list(ENTITY), "left").select(
        "panel_id", F.col("funding_funding_rate").alias("funding_rate"), (F.round("funding_zscore", 5) + F.lit(0.0)).alias("funding_zscore90"), "funding_source_us", status.alias("funding_coverage_status"))


def jn_premium(spark, d):
    """Panel rows with the futures' premium over spot and its z-score of 90 bars without a gap, from a bar strictly before."""
    b = bars(spark, d)
    spot = b.where(F.col("market") == "spot").select("symbol", "timeframe", "slot_no", F.col("close").alias("spot_"))
    p = b.where(F.col("market") != "spot").select(*SERIES, "block", "slot_no", "close").join(spot, ["symbol", "timeframe", "slot_no"])
    p = segmented(p.withColumn("premium", sdiv(F.col("close"), F.col("spot_")) - 1))
    z = indicators(p, ["premium_z"]).select(*SERIES, (F.col("slot_no") * step_us(F.col("timeframe"))).alias("bar_us"), "premium", "premium_zscore90")
    rows = table(spark, d, "panel").select("panel_id", *SERIES, micros(F.col("timestamp")).alias("us")).distinct()
    a = joins.asof(rows, "us", {"p": joins.Source(z, "bar_us", ("premium", "premium_zscore90"))}, SERIES, strict=True)
    return a.select("panel_id", (F.round("p_premium", 8) + F.lit(0.0)).alias("premium"), (F.round("p_premium_zscore90", 5) + F.lit(0.0)).alias("premium_zscore90"), F.col("p_source_us").alias("premium_source_us"), F.col("p_coverage").alias("premium_coverage_status"))


def jn_manifest(spark, d):
    """Archive objects with their entity's first archive month and the checksum verdict on record for their series."""
    o = _objects(spark, d)
    first = o.groupBy(*ENTITY).agg(F.min("archive_month").alias("first_archive_month"))
    rec = table(spark, d, "integrity_summary").groupBy(*SERIES).agg(F.max("raw_checksum_verified").alias("raw_checksum_verified"))
    return o.join(first, list(ENTITY), "left").join(rec, list(SERIES), "left")


def jn_context(spark, d):
    """Months of bars of every member of a monthly cohort, its own month and the two before it."""
    month = F.date_format(F.timestamp_micros(F.col("slot_no") * step_us(F.col("timeframe"))), "yyyy-MM")
    o = bars(spark, d).groupBy(*ENTITY, month.alias("archive_month")).agg(F.count("*").alias("n"))
    return joins.month_context(_traded(spark, d), o, ENTITY, "universe_month", "archive_month")


def jn_positional(spark, d):
    """Futures bars beside the spot bar at the same position of its series, NULL where that series is shorter."""
    b = joins.positions(bars(spark, d).select(*SERIES, "slot_no", "close"), SERIES, "slot_no")
    s = b.where(F.col("market") == "spot").select("symbol", "timeframe", "at", F.col("slot_no").alias("spot_slot_no"))
    return b.where(F.col("market") != "spot").select(*SERIES, "slot_no", "at").join(s, ["symbol", "timeframe", "at"], "left")


def st_sort(spark, d):
    """Funding events in one order per market: time, then id."""
    f = table(spark, d, "funding_events").where(F.col("timestamp").isNotNull()).select("market", "funding_id", F.struct("timestamp", "funding_id").alias("order"))
    return joins.positions(f, ["market"], "order", "ordinal").select("market", "funding_id", "ordinal")


def ag_estimate(spark, d):
    """Bytes of archive lines per market and what they take up unpacked, as parquet and with working space."""
    g = table(spark, d, "raw_klines").groupBy("market").agg(F.sum(F.octet_length("raw_line")).alias("bytes"))
    return g.select("*", *[(F.col("bytes") * F.lit(x)).alias(n) for n, x in (("unpacked", 4.0), ("parquet", 1.5), ("working", 5.0))])


def flt_offgrid(spark, d):
    """Deliveries per series by verdict: kept, quarantined off the grid, or off it in a series that is not audited."""
    k = quality.quarantined(table(spark, d, "klines"), table(spark, d, "integrity_summary"))
    return k.groupBy(*SERIES).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("KEPT", "QUARANTINED", "NOT_ALLOWED")])


def flt_cutoff(spark, d):
    """Per series: deliveries of bars that were complete when they were ingested, and of such that were not."""
    k = table(spark, d, "klines").where(F.col("ingested_at").isNotNull() & F.col("open_time").isNotNull())
    done = micros(F.col("open_time")) <= quality.completed_cutoff(F.col("ingested_at"), F.col("timeframe"))
    return k.groupBy(*SERIES).agg(F.count_if(done).alias("complete"), F.count_if(~done).alias("incomplete"))


def _daily(spark, d):
    r = readings(table(spark, d, "klines").where(F.col("timeframe") == "1d"), ["quote_volume"])
    return r.select(*ENTITY, F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot_no").cast("int")).alias("day"), "quote_volume")


def ag_month_volume(spark, d):
    return _shown(cohorts.month_volume(_daily(spark, d)))


GROUP = ("campaign_id", "market", "universe_month")


def _volumes(spark, d):
    v = table(spark, d, "monthly_volume").withColumn("universe_month", F.substring("universe_month", 1, 7))
    return v.groupBy(*GROUP, "symbol").agg(
        number(F.max_by("prior_month_quote_volume", "recorded_at")).alias("volume"), F.max_by("coverage_ratio", F.struct("recorded_at", "coverage_ratio")).alias("coverage"),
        F.min("volume_month").alias("volume_month"), F.min("first_observed").alias("first_observed"))


def _universe(spark, d, verified=False):
    return cohorts.selected_universe(_volumes(spark, d), GROUP, verified)


def tk_universe(spark, d):
    """Symbols ranked by the volume of the month before, with why the others are not."""
    return _universe(spark, d)


def tk_universe_verified(spark, d):
    """The same where a symbol must have been seen before that month began and be covered throughout it."""
    return _universe(spark, d, True)


def _traded(spark, d):
    """The hundred symbols of each market and month with the largest quote volume in the daily bars of the month before."""
    v = cohorts.month_volume(_daily(spark, d)).select(
        "market", "universe_month", "symbol", F.col("quote_volume").alias("volume"), F.col("coverage_ratio").alias("coverage"), "volume_month", F.to_timestamp("first_observed").alias("first_observed"))
    return cohorts.selected_universe(v, ("market", "universe_month")).where(F.col("selected_top100")).select(*ENTITY, "universe_month")


def ag_cohort_summary(spark, d):
    return cohorts.cohort_counts(_universe(spark, d), GROUP)


def ag_shortfall(spark, d):
    """Groups with fewer than 20 ranked symbols."""
    return ag_cohort_summary(spark, d).where(F.col("top20") < 20).select(*GROUP, "top20")


def ag_membership_hash(spark, d):
    m = _universe(spark, d).where(F.col("selected_top50"))
    return quality.table_hash(m, ["symbol", "rank_no"], GROUP)


def jn_membership_diff(spark, d):
    return cohorts.membership_changes(
        _universe(spark, d), _universe(spark, d, True), (*GROUP, "symbol"), ["selected_top20", "selected_top50", "selected_top100"])


def jn_cohort(spark, d):
    """Panel rows marked where their symbol is among its month's first fifty in any campaign."""
    top = _universe(spark, d).where(F.col("selected_top50")).select("market", "universe_month", "symbol").distinct().withColumn("selected", F.lit(True))
    p = table(spark, d, "panel").select("panel_id", *ENTITY, "universe_month").distinct()
    return p.join(top, ["market", "universe_month", "symbol"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def ag_breadth(spark, d):
    """Share of symbols above their 50-bar average per market, timeframe and slot."""
    return cohorts.breadth(above_average(spark, d), ("market", "timeframe", "slot_no"), F.col("above"))


def ag_breadth_cohort(spark, d):
    """The same over the symbols selected for the slot's month, four in five of which must be past their warm-up."""
    month = F.date_format(F.timestamp_micros(F.col("slot_no") * step_us(F.col("timeframe"))), "yyyy-MM")
    a = above_average(spark, d).withColumn("universe_month", month).join(_traded(spark, d), [*ENTITY, "universe_month"], "left_semi")
    return cohorts.breadth(a, ("market", "timeframe", "slot_no"), F.col("above"), 0.8)


def jn_breadth_eq(spark, d):
    """The breadth of a bar's slot brought back to the bar."""
    a = above_average(spark, d)
    b = cohorts.breadth(a, ("market", "timeframe", "slot_no"), F.col("above"))
    return a.join(b.select("market", "timeframe", "slot_no", "breadth"), ["market", "timeframe", "slot_no"], "left").select(*SERIES, "slot_no", "above", "breadth")


def _objects(spark, d):
    o = table(spark, d, "raw_klines").groupBy(F.col("archive_object").alias("key")).agg(F.count("*").alias("lines"))
    return cohorts.archive_objects(o)


def ag_census_obj(spark, d):
    return _objects(spark, d)


def ag_census_sym(spark, d):
    return cohorts.symbol_census(_objects(spark, d))


def ag_manifest_sum(spark, d):
    return table(spark, d, "raw_klines").groupBy(*SERIES).agg(
        F.countDistinct("archive_object").alias("objects"), F.count("*").alias("lines"), F.sum(F.length("raw_line")).alias("characters"))


def so_except(spark, d):
    """Entities that have panel rows but no bars, and the other way round."""
    a, k = (table(spark, d, t).select(*ENTITY).distinct() for t in ("panel", "klines"))
    return a.exceptAll(k).withColumn("side", F.lit("panel")).unionByName(k.exceptAll(a).withColumn("side", F.lit("bars")))


def so_intersect(spark, d):
    """Entities with both panel rows and funding events."""
    return table(spark, d, "panel").select(*ENTITY).intersect(table(spark, d, "funding_events").select(*ENTITY))


def so_union(spark, d):
    """Rows per entity over panel and funding events together."""
    u = table(spark, d, "panel").select(*ENTITY).unionByName(table(spark, d, "funding_events").select(*ENTITY))
    return u.groupBy(*ENTITY).agg(F.count("*").alias("n"))


def so_distinct(spark, d):
    return table(spark, d, "panel").dropDuplicates().groupBy(*ENTITY).agg(F.count("*").alias("n"))


def lm_top1(spark, d):
    """The symbol with the largest volume per group."""
    v = _volumes(spark, d).where((F.col("volume") >= 0) & ~F.isnan("volume"))
    g = v.groupBy(*GROUP).agg(F.max("volume").alias("volume"))
    return v.join(g, [*GROUP, "volume"]).groupBy(*GROUP, "volume").agg(F.min("symbol").alias("symbol"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.startswith(("rs_", "qa_", "jn_", "ft_", "ag_", "tk_", "so_", "lm_", "st_", "flt_"))}

_AGG = "arg_min(open, slot_no) AS open, max(high) AS high, min(low) AS low, arg_max(close, slot_no) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume, sum(trade_count)::BIGINT AS trade_count, sum(taker_buy_volume) AS taker_buy_volume, count(*) AS bars"


def _rs(target: int) -> str:
    return f"""rs AS (SELECT market, symbol, timeframe, slot_no // ({target} // st) AS bucket, {_AGG}, any_value({target} // st) AS need FROM bars
  WHERE st < {target} AND {target} % st = 0 GROUP BY market, symbol, timeframe, slot_no // ({target} // st)
  HAVING count(*) = any_value({target} // st))"""


def _rs_sql(target: int) -> str:
    r = ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in ("volume", "quote_volume", "taker_buy_volume"))
    return f"WITH {BARS_SQL},\n{_rs(target)}\nSELECT market, symbol, timeframe, bucket, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, {r}, coalesce(trade_count, 0) AS trade_count, bars FROM rs"


def _pairs_sql(name: str, target: int) -> str:
    fields = ", ".join(f"{{'field': '{f}', 'r': coalesce(r.{f}, 0)::DOUBLE, 'n': n.{f}::DOUBLE, 'e': {str(f == 'trade_count').lower()}}}" for f in FIELDS)
    return f"""SELECT r.market, r.symbol, r.timeframe AS source, '{name}' AS target, unnest([{fields}], recursive := true)
  FROM ({_rs(target).replace("rs AS (", "", 1)[:-1]}) r JOIN bars n ON n.market = r.market AND n.symbol = r.symbol AND n.slot_no = r.bucket AND n.timeframe = '{name}'"""


_CMP = f"""WITH {BARS_SQL}, cmp AS ({" UNION ALL ".join(_pairs_sql(n, t) for n, t in TARGETS.items())}),
res AS (SELECT market, symbol, source, target, field, count(*) AS compared, count(*) FILTER (NOT coalesce(abs(r - n) <= CASE WHEN e THEN 0 ELSE 1e-6 + 1e-9 * abs(n) END, FALSE)) AS mismatch_count,
  round(max(abs(r - n)), 4) AS max_abs_diff FROM cmp GROUP BY ALL)
"""
_CONTIG = f""", counted AS (SELECT *, count(*) OVER (PARTITION BY market, symbol, timeframe, segment_id) AS run_n FROM bars),
co AS (SELECT market, symbol, timeframe, bucket, open, high, low, close, coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(trade_count, 0) AS trade_count, coalesce(taker_buy_volume, 0) AS taker_buy_volume, bars FROM rs
  UNION ALL SELECT market, symbol, timeframe, slot_no, open, high, low, close, coalesce(volume, 0), coalesce(quote_volume, 0), coalesce(trade_count, 0), coalesce(taker_buy_volume, 0), 1 FROM counted WHERE st = {HOUR} AND run_n > 1)
SELECT market, symbol, timeframe, bucket, {", ".join(f"round({c}, 6) AS {c}" for c in "open high low close volume quote_volume taker_buy_volume".split())}, trade_count, bars FROM co"""
_CLEANED = f"""WITH kd AS (SELECT market, symbol, timeframe, open_time, open, high, low, close, volume, quote_volume, trade_count, taker_buy_volume FROM klines
  WHERE epoch_us(klines.open_time) % (CASE timeframe WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 ELSE 86400 END * 1000000::BIGINT) = 0),
kk AS (SELECT DISTINCT *, NULL::TIMESTAMP AS ingested_at FROM kd), k1 AS (SELECT * FROM kk QUALIFY count(*) OVER (PARTITION BY market, symbol, timeframe, open_time) = 1),
{BARS_SQL.replace("FROM klines)", "FROM k1)", 1)}"""
_LINES = _JUDGED + r""", al AS (SELECT r.market, r.symbol, r.timeframe, r.archive_object, regexp_extract(r.archive_object, '-([0-9]{4}-[0-9]{2})\.[a-z]+$', 1) AS archive_month, o, n[1] AS open, n[2] AS high, n[3] AS low, n[4] AS close, n[6] AS quote_volume
  FROM judged j JOIN raw_klines r USING (line_id) WHERE reason IS NULL)"""
_STEP = "(CASE timeframe WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 ELSE 86400 END * 1000000::BIGINT)"
_SCORED = """sc AS (SELECT *, CASE WHEN count(*) OVER w = 90 THEN (funding_rate - avg(funding_rate) OVER w) / nullif(stddev_pop(funding_rate) OVER w, 0) END AS z FROM funding_events WHERE funding_rate IS NOT NULL
  WINDOW w AS (PARTITION BY market, symbol ORDER BY "timestamp", funding_id ROWS 89 PRECEDING)),
s1 AS (SELECT market, symbol, epoch_us("timestamp") AS t, funding_rate, z FROM sc QUALIFY row_number() OVER (PARTITION BY market, symbol, "timestamp" ORDER BY funding_id DESC) = 1)"""
_PANEL = """p AS (SELECT DISTINCT panel_id, market, symbol, epoch_us("timestamp") AS us FROM panel),
f AS (SELECT market, symbol, epoch_us("timestamp") AS t, funding_rate, funding_id FROM funding_events WHERE funding_rate IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY market, symbol, "timestamp" ORDER BY funding_id DESC) = 1)
"""


def _asof_sql(op: str, age: int | None, coverage: bool = True) -> str:
    stale = f"us - t > {age}" if age else "FALSE"
    cov = f", CASE WHEN t IS NULL THEN 'NO_PRIOR_OBSERVATION' WHEN {stale} THEN 'STALE' ELSE 'AVAILABLE' END AS funding_coverage" if coverage else ""
    return f"""WITH {_PANEL}
SELECT panel_id, p.market, p.symbol, CASE WHEN NOT coalesce({stale}, FALSE) THEN funding_rate END AS funding_funding_rate, CASE WHEN NOT coalesce({stale}, FALSE) THEN funding_id END AS funding_funding_id,
  t AS funding_source_us, us - t AS funding_age_us{cov}
FROM p ASOF LEFT JOIN f ON f.market = p.market AND f.symbol = p.symbol AND p.us {op} f.t"""


_VOL = """v0 AS (SELECT *, substr(universe_month, 1, 7) AS um FROM monthly_volume),
seen AS (SELECT campaign_id, market, um, symbol, min(volume_month) AS volume_month, min(first_observed) AS first_observed FROM v0 GROUP BY ALL),
v1 AS (SELECT campaign_id, market, um, symbol, CASE WHEN isfinite(prior_month_quote_volume) THEN prior_month_quote_volume END AS volume, coverage_ratio AS coverage FROM v0
  QUALIFY row_number() OVER (PARTITION BY campaign_id, market, um, symbol ORDER BY recorded_at DESC, coverage_ratio DESC NULLS LAST) = 1),
v AS (SELECT campaign_id, market, um AS universe_month, symbol, volume, coverage, volume_month, first_observed, (um || '-01')::TIMESTAMP AS m FROM v1 JOIN seen USING (campaign_id, market, um, symbol))"""


def _uni(name: str, verified: bool) -> str:
    early = "coalesce(first_observed >= m" + (" - INTERVAL 1 MONTH" if verified else "") + ", TRUE)"
    partial = "WHEN isnan(coverage) OR coverage < 1 THEN 'PARTIAL_PRIOR_MONTH'" if verified else ""
    ok = "volume >= 0 AND NOT " + early + (" AND coverage IS NOT NULL AND NOT isnan(coverage) AND coverage >= 1" if verified else "")
    return f"""{name}0 AS (SELECT *, coalesce({ok}, FALSE) AS ok, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' WHEN volume IS NULL THEN 'NO_VOLUME' {partial} WHEN {early} THEN 'NOT_OBSERVED' ELSE 'ELIGIBLE' END AS reason FROM v),
{name}1 AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY campaign_id, market, universe_month, ok ORDER BY volume DESC, symbol) END AS rank_no FROM {name}0),
{name} AS (SELECT campaign_id, market, universe_month, symbol, volume, reason, rank_no, coalesce(rank_no <= 20, FALSE) AS selected_top20, coalesce(rank_no <= 50, FALSE) AS selected_top50, coalesce(rank_no <= 100, FALSE) AS selected_top100 FROM {name}1)"""


_TRADED = f"""dd AS (SELECT market, symbol, DATE '1970-01-01' + slot_no::INT AS day, quote_volume FROM reading WHERE timeframe = '1d'),
mm AS (SELECT market, symbol, date_trunc('month', day) AS vm, sum(quote_volume) FILTER (NOT isnan(quote_volume)) AS volume, count(DISTINCT day) / any_value(day(last_day(day))) AS coverage, min(day) AS f FROM dd GROUP BY ALL),
v AS (SELECT '' AS campaign_id, market, symbol, strftime(vm + INTERVAL 1 MONTH, '%Y-%m') AS universe_month, strftime(vm, '%Y-%m') AS volume_month, volume, coverage, (min(f) OVER (PARTITION BY market, symbol))::TIMESTAMP AS first_observed, (vm + INTERVAL 1 MONTH)::TIMESTAMP AS m FROM mm),
{_uni('u', False)}, top AS (SELECT market, symbol, universe_month FROM u WHERE selected_top100)"""
_CENSUS = r"""o AS (SELECT archive_object AS key, count(*) AS lines FROM raw_klines GROUP BY 1),
c AS (SELECT key, lines, string_split(key, '/')[1] AS market, string_split(key, '/')[2] AS symbol, string_split(key, '/')[3] AS timeframe, regexp_extract(key, '-([0-9]{4}-[0-9]{2})\.[a-z]+$', 1) AS archive_month FROM o)"""
_TIMES = """t0 AS (SELECT market, symbol, timeframe, epoch_us(open_time) AS us, st AS step, count(*) AS copies FROM steps GROUP BY ALL),
t AS (SELECT *, lag(us) OVER (PARTITION BY market, symbol, timeframe ORDER BY us) AS prev_us FROM t0)"""
_HASH = lambda cols: "sum(('0x' || substr(sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('v' || {c}::VARCHAR, 'n')" for c in cols) + ")), 1, 15))::UBIGINT::HUGEINT)::VARCHAR"
_BREADTH = f"""a AS (SELECT market, symbol, timeframe, slot_no, close > e50 AS above FROM av),
g AS (SELECT market, timeframe, slot_no, count(*) AS selected_count, count(above) AS valid_count, count(*) FILTER (above) AS above_count FROM a GROUP BY ALL)
"""
_B50 = f"WITH RECURSIVE {BARS_SQL}{_ema({'e50': _E['e50']})}, {_BREADTH}"


def _breadth_sql(least: float) -> str:
    ok = f"valid_count > 0 AND valid_count >= {least} * selected_count"
    return f"{_B50} SELECT *, CASE WHEN {ok} THEN above_count / valid_count END AS breadth, CASE WHEN {ok} THEN 'AVAILABLE' ELSE 'INSUFFICIENT_CROSS_SECTION' END AS status FROM g"


SQL = {
    "rs_strict": _rs_sql(HOUR), "rs_contig": f"WITH {BARS_SQL}, {_rs(HOUR)}{_CONTIG}", "rs_dedup_contig": f"{_CLEANED}, {_rs(HOUR)}{_CONTIG}",
    "qa_tf_driver": _CMP + "SELECT source, target, field, sum(compared)::BIGINT AS compared, sum(mismatch_count)::BIGINT AS mismatch_count FROM res GROUP BY ALL",
    "qa_tf_compare": _CMP + "SELECT *, CASE WHEN mismatch_count = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM res",
    "qa_tf_policy": _CMP + "SELECT market, symbol, source, target, CASE WHEN max(mismatch_count) = 0 THEN 'NATIVE' ELSE 'RESAMPLED' END AS policy FROM res GROUP BY ALL",
    "qa_validate": f"""WITH {_READ}, {_TIMES},
content AS (SELECT market, symbol, timeframe, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR quote_volume IS NULL) AS malformed,
  count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close, volume, quote_volume) < 0) AS impossible FROM klines GROUP BY ALL),
times AS (SELECT market, symbol, timeframe, coalesce(sum(copies) FILTER (copies > 1), 0) AS dup, count(*) FILTER (us - prev_us > step) AS gaps,
  coalesce(sum((us - prev_us) // step - 1) FILTER (us - prev_us > step), 0) AS missing, count(*) FILTER (us - prev_us < step OR (us - prev_us) % step <> 0) AS irregular FROM t GROUP BY ALL),
rows AS (SELECT market, symbol, timeframe, unnest([{{'code': 'DUPLICATE_TIMESTAMP', 'severity': 'ERROR', 'n': dup, 'there': dup > 0}}, {{'code': 'MALFORMED_CANDLE', 'severity': 'ERROR', 'n': malformed, 'there': malformed > 0}},
  {{'code': 'IMPOSSIBLE_OHLC', 'severity': 'ERROR', 'n': impossible, 'there': impossible > 0}}, {{'code': 'MISSING_INTERVAL', 'severity': 'WARN', 'n': missing, 'there': gaps > 0}},
  {{'code': 'IRREGULAR_INTERVAL', 'severity': 'ERROR', 'n': irregular, 'there': irregular > 0}}], recursive := true) FROM content JOIN times USING (market, symbol, timeframe))
SELECT market, symbol, timeframe, code, severity, n::BIGINT AS n FROM rows WHERE there""",
    "qa_dedup": """WITH g AS (SELECT market, symbol, timeframe, k.open_time, count(DISTINCT (open, high, low, close, volume, quote_volume)) AS v FROM klines k GROUP BY market, symbol, timeframe, k.open_time)
SELECT market, symbol, timeframe, count(*) FILTER (v = 1) AS kept, count(*) FILTER (v > 1) AS conflicts FROM g GROUP BY ALL""",
    "qa_1d": f"""{_LINES}, l AS (SELECT *, lag(o) OVER (PARTITION BY archive_object ORDER BY o) AS p FROM al WHERE timeframe = '1d'),
g AS (SELECT archive_object, count(*) AS rows, count(DISTINCT o // {DAY}) AS days, round(coalesce(sum(quote_volume), 0), 6) AS quote_volume,
  concat_ws(';', CASE WHEN bool_or(o = p) THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN bool_or(high < greatest(open, close, low) OR low > least(open, close, high) OR quote_volume < 0) THEN 'IMPOSSIBLE_OHLC' END, CASE WHEN bool_or(o - p > {DAY}) THEN 'MISSING_INTERVAL' END) AS issue_codes FROM l GROUP BY 1)
SELECT *, CASE WHEN issue_codes = '' THEN 'PASS' ELSE 'ISSUES' END AS integrity_status FROM g""",
    "qa_scan": _JUDGED + """, g AS (SELECT r.archive_object, count(*) FILTER (reason IS NOT NULL) AS b FROM raw_klines r LEFT JOIN judged j USING (line_id) GROUP BY 1)
SELECT CASE WHEN b > 0 THEN 'BAD' ELSE 'GOOD' END AS status, count(*) AS objects, sum(b)::BIGINT AS bad_lines FROM g GROUP BY 1""",
    "qa_inspect": f"""SELECT archive_object, count(*) AS n_rows, {_HASH(['line_no', 'raw_line'])} AS table_hash, count(*) FILTER (regexp_matches(raw_line, '^\\x{{FEFF}}?"?open_time')) AS headers, max(len(string_split(raw_line, ','))) AS columns FROM raw_klines GROUP BY 1""",
    "qa_offgrid_audit": f"""{_LINES}, l AS (SELECT *, lag(o) OVER (PARTITION BY market, symbol, timeframe ORDER BY archive_month, o) AS p FROM al), k AS (SELECT market, symbol, timeframe, archive_month, o AS us, p AS prev_us, o - p AS delta_us,
  CASE WHEN o < p THEN 'TIME_REVERSAL' WHEN o = p THEN 'DUPLICATE_TIMESTAMP' WHEN (o - p) % {_STEP} <> 0 THEN 'OFF_GRID_TIMESTAMP' END AS anomaly_type FROM l) SELECT * FROM k WHERE anomaly_type IS NOT NULL""",
    "qa_lifecycle_rec": f"WITH {_READ}, {_TIMES} SELECT market, symbol, timeframe, min(us) AS first_us, max(us) AS last_us, count(*) AS observed, coalesce(sum(greatest(0, (us - prev_us) // step - 1)), 0)::BIGINT AS missing, 'UNKNOWN' AS listing_evidence, 'UNKNOWN' AS delisting_evidence FROM t GROUP BY ALL",
    "flt_offgrid": f"""WITH {_READ}, a AS (SELECT DISTINCT market, symbol, timeframe, TRUE AS ok FROM integrity_summary), k AS (SELECT s.market, s.symbol, s.timeframe, epoch_us(open_time) % st <> 0 AS off, a.ok FROM steps s LEFT JOIN a USING (market, symbol, timeframe))
SELECT market, symbol, timeframe, count(*) FILTER (NOT off) AS kept, count(*) FILTER (off AND ok) AS quarantined, count(*) FILTER (off AND ok IS NULL) AS not_allowed FROM k GROUP BY ALL""",
    "flt_cutoff": f"WITH {_READ}, k AS (SELECT *, epoch_us(open_time) <= (epoch_us(ingested_at) // st - 1) * st AS done FROM steps WHERE ingested_at IS NOT NULL AND open_time IS NOT NULL) SELECT market, symbol, timeframe, count(*) FILTER (done) AS complete, count(*) FILTER (NOT done) AS incomplete FROM k GROUP BY ALL",
    "ag_estimate": "SELECT market, sum(strlen(raw_line))::BIGINT AS bytes, sum(strlen(raw_line)) * 4.0::DOUBLE AS unpacked, sum(strlen(raw_line)) * 1.5::DOUBLE AS parquet, sum(strlen(raw_line)) * 5.0::DOUBLE AS working FROM raw_klines GROUP BY 1",
    "st_sort": 'SELECT market, funding_id, row_number() OVER (PARTITION BY market ORDER BY "timestamp", funding_id) - 1 AS ordinal FROM funding_events WHERE "timestamp" IS NOT NULL',
    "jn_funding": f"""WITH {_PANEL}, {_SCORED}, k AS (SELECT DISTINCT market, symbol, TRUE AS known FROM sc)
SELECT panel_id, s1.funding_rate, round(z, 5) + 0.0 AS funding_zscore90, s1.t AS funding_source_us, CASE WHEN known IS NULL THEN 'HISTORICAL_UNAVAILABLE' WHEN s1.funding_rate IS NULL THEN 'NO_PRIOR_EVENT' ELSE 'AVAILABLE' END AS funding_coverage_status
FROM p ASOF LEFT JOIN s1 ON s1.market = p.market AND s1.symbol = p.symbol AND p.us >= s1.t LEFT JOIN k ON k.market = p.market AND k.symbol = p.symbol""",
    "jn_premium": f"""WITH {BARS_SQL}, pb AS (SELECT u.market, u.symbol, u.timeframe, u.slot_no, u.st, u.close / nullif(s.close, 0) - 1 AS premium FROM bars u JOIN bars s ON s.market = 'spot' AND u.market <> 'spot' AND s.symbol = u.symbol AND s.timeframe = u.timeframe AND s.slot_no = u.slot_no),
pg AS (SELECT *, slot_no - row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY slot_no) AS grp FROM pb),
pz AS (SELECT market, symbol, timeframe, slot_no * st AS t, premium, CASE WHEN count(premium) OVER w = 90 THEN (premium - avg(premium) OVER w) / nullif(stddev_pop(premium) OVER w, 0) END AS z FROM pg WINDOW w AS (PARTITION BY market, symbol, timeframe, grp ORDER BY slot_no ROWS 89 PRECEDING)),
p AS (SELECT DISTINCT panel_id, market, symbol, timeframe, epoch_us("timestamp") AS us FROM panel)
SELECT panel_id, round(premium, 8) + 0.0 AS premium, round(z, 5) + 0.0 AS premium_zscore90, t AS premium_source_us, CASE WHEN t IS NULL THEN 'NO_PRIOR_OBSERVATION' ELSE 'AVAILABLE' END AS premium_coverage_status
FROM p ASOF LEFT JOIN pz ON pz.market = p.market AND pz.symbol = p.symbol AND pz.timeframe = p.timeframe AND p.us > pz.t""",
    "jn_manifest": f"""WITH {_CENSUS}, f AS (SELECT market, symbol, min(archive_month) AS first_archive_month FROM c GROUP BY ALL), r AS (SELECT market, symbol, timeframe, max(raw_checksum_verified) AS raw_checksum_verified FROM integrity_summary GROUP BY ALL)
SELECT * FROM c LEFT JOIN f USING (market, symbol) LEFT JOIN r USING (market, symbol, timeframe)""",
    "jn_context": f"""WITH {BARS_SQL}, {_TRADED}, w AS (SELECT market, symbol, strftime((universe_month || '-01')::DATE - to_months(k), '%Y-%m') AS archive_month, bool_or(k = 0) AS own FROM top CROSS JOIN (VALUES (0), (1), (2)) x(k) GROUP BY ALL),
ob AS (SELECT market, symbol, strftime(make_timestamp(slot_no * st), '%Y-%m') AS archive_month, count(*) AS n FROM bars GROUP BY ALL)
SELECT market, symbol, archive_month, n, CASE WHEN own THEN 'RESEARCH_ELIGIBLE' ELSE 'WARMUP_CONTEXT_ONLY' END AS row_class FROM ob JOIN w USING (market, symbol, archive_month)""",
    "jn_positional": f"""WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY slot_no) - 1 AS i FROM bars), s AS (SELECT symbol, timeframe, i, slot_no AS ss FROM n WHERE market = 'spot')
SELECT market, n.symbol, n.timeframe, slot_no, n.i AS "at", ss AS spot_slot_no FROM n LEFT JOIN s ON s.symbol = n.symbol AND s.timeframe = n.timeframe AND s.i = n.i WHERE market <> 'spot'""",
    "qa_lifecycle": f"WITH {_READ}, {_TIMES} SELECT market, symbol, timeframe, min(us) AS first_us, max(us) AS last_us, count(*) AS observed, coalesce(sum(greatest(0, (us - prev_us) // step - 1)), 0)::BIGINT AS missing FROM t GROUP BY ALL",
    "qa_hash": f"SELECT market, count(*) AS n_rows, {_HASH(['funding_id', 'symbol', 'funding_interval_hours'])} AS table_hash FROM funding_events GROUP BY 1",
    "jn_asof": _asof_sql(">=", 8 * HOUR), "jn_asof_event": _asof_sql(">=", None, False), "jn_asof_strict": _asof_sql(">", None),
    "jn_panel": f"""WITH {BARS_SQL}, {_PANEL},
h AS (SELECT market, symbol, close, (slot_no + 1) * {HOUR} AS t FROM bars WHERE timeframe = '1h')
SELECT panel_id, p.market, p.symbol, f.funding_rate AS funding_funding_rate, f.funding_id AS funding_funding_id, us - f.t AS funding_age_us, CASE WHEN f.t IS NULL THEN 'NO_PRIOR_OBSERVATION' ELSE 'AVAILABLE' END AS funding_coverage,
  CASE WHEN us - h.t <= {2 * HOUR} THEN h.close END AS hour_close, us - h.t AS hour_age_us, CASE WHEN h.t IS NULL THEN 'NO_PRIOR_OBSERVATION' WHEN us - h.t > {2 * HOUR} THEN 'STALE' ELSE 'AVAILABLE' END AS hour_coverage
FROM p ASOF LEFT JOIN f ON f.market = p.market AND f.symbol = p.symbol AND p.us >= f.t ASOF LEFT JOIN h ON h.market = p.market AND h.symbol = p.symbol AND p.us >= h.t""",
    "jn_interval": f"""WITH p AS (SELECT DISTINCT panel_id, market, symbol, epoch_us("timestamp") AS us FROM panel)
SELECT panel_id, count(e.funding_id) AS crossed, round(coalesce(sum(e.funding_rate), 0), 9) + 0.0 AS rate_sum, round(-(CASE WHEN p.market = 'um' THEN 1 ELSE -1 END) * coalesce(sum(e.funding_rate), 0), 9) + 0.0 AS cashflow
FROM p LEFT JOIN funding_events e ON e.market = p.market AND e.symbol = p.symbol AND e.funding_rate IS NOT NULL AND epoch_us(e."timestamp") > p.us AND epoch_us(e."timestamp") <= p.us + {8 * HOUR}
GROUP BY panel_id, p.market, p.symbol, p.us""",
    "ft_funding_event_z": """WITH f AS (SELECT *, count(*) OVER w AS n, avg(funding_rate) OVER w AS m, stddev_pop(funding_rate) OVER w AS s FROM funding_events WHERE funding_rate IS NOT NULL
  WINDOW w AS (PARTITION BY market, symbol ORDER BY "timestamp", funding_id ROWS 89 PRECEDING))
SELECT funding_id, round(CASE WHEN n = 90 THEN (funding_rate - m) / nullif(s, 0) END, 5) + 0.0 AS funding_zscore90 FROM f""",
    "ag_month_volume": f"""WITH {_READ},
dd AS (SELECT market, symbol, DATE '1970-01-01' + slot_no::INT AS day, quote_volume FROM reading WHERE timeframe = '1d'),
m AS (SELECT market, symbol, date_trunc('month', day) AS m, sum(quote_volume) FILTER (NOT isnan(quote_volume)) AS quote_volume, count(DISTINCT day) AS observed_days, min(day) AS f FROM dd GROUP BY ALL)
SELECT market, symbol, strftime(m, '%Y-%m') AS volume_month, strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS universe_month, round(quote_volume, 6) AS quote_volume, observed_days, day(last_day(m))::INT AS expected_days,
  round(observed_days / day(last_day(m)), 6) AS coverage_ratio, strftime(min(f) OVER (PARTITION BY market, symbol), '%Y-%m-%d') AS first_observed FROM m""",
    "tk_universe": f"WITH {_VOL}, {_uni('u', False)} SELECT * FROM u",
    "tk_universe_verified": f"WITH {_VOL}, {_uni('u', True)} SELECT * FROM u",
    "ag_cohort_summary": f"WITH {_VOL}, {_uni('u', False)} SELECT campaign_id, market, universe_month, count(*) AS candidate_count, count(rank_no) AS eligible_count, count(*) FILTER (rank_no <= 20) AS top20, count(*) FILTER (rank_no <= 50) AS top50, count(*) FILTER (rank_no <= 100) AS top100 FROM u GROUP BY ALL",
    "ag_shortfall": f"WITH {_VOL}, {_uni('u', False)} SELECT campaign_id, market, universe_month, count(*) FILTER (rank_no <= 20) AS top20 FROM u GROUP BY ALL HAVING count(*) FILTER (rank_no <= 20) < 20",
    "ag_membership_hash": f"WITH {_VOL}, {_uni('u', False)} SELECT campaign_id, market, universe_month, count(*) AS n_rows, {_HASH(['symbol', 'rank_no'])} AS table_hash FROM u WHERE selected_top50 GROUP BY ALL",
    "jn_membership_diff": f"""WITH {_VOL}, {_uni('u', False)}, {_uni('w', True)}
SELECT * FROM (SELECT campaign_id, market, universe_month, symbol, u.selected_top20 AS before_selected_top20, w.selected_top20 AS after_selected_top20, u.selected_top50 AS before_selected_top50,
  w.selected_top50 AS after_selected_top50, u.selected_top100 AS before_selected_top100, w.selected_top100 AS after_selected_top100 FROM u JOIN w USING (campaign_id, market, universe_month, symbol))
WHERE before_selected_top20 <> after_selected_top20 OR before_selected_top50 <> after_selected_top50 OR before_selected_top100 <> after_selected_top100""",
    "jn_cohort": f"""WITH {_VOL}, {_uni('u', False)}, t AS (SELECT DISTINCT market, universe_month, symbol FROM u WHERE selected_top50)
SELECT DISTINCT p.panel_id, p.market, p.symbol, p.universe_month, t.symbol IS NOT NULL AS selected FROM panel p LEFT JOIN t ON t.market = p.market AND t.universe_month = p.universe_month AND t.symbol = p.symbol""",
    "ag_breadth": _breadth_sql(0),
    "ag_breadth_cohort": _breadth_sql(0.8).replace(
        ", a AS (SELECT", f", {_TRADED}, a AS (SELECT", 1).replace("FROM av),", "FROM av WHERE (market, symbol, strftime(make_timestamp(slot_no * st), '%Y-%m')) IN (SELECT (market, symbol, universe_month) FROM top)),", 1),
    "jn_breadth_eq": f"{_B50} SELECT a.market, a.symbol, a.timeframe, a.slot_no, above, CASE WHEN valid_count > 0 THEN above_count / valid_count END AS breadth FROM a JOIN g USING (market, timeframe, slot_no)",
    "ag_census_obj": f"WITH {_CENSUS} SELECT * FROM c",
    "ag_census_sym": f"""WITH {_CENSUS} SELECT market, symbol, timeframe, min(archive_month) AS first_month, max(archive_month) AS last_month, count(DISTINCT archive_month) AS months, count(*) AS objects, sum(lines)::BIGINT AS lines,
  date_diff('month', min((archive_month || '-01')::DATE), max((archive_month || '-01')::DATE)) + 1 - count(DISTINCT archive_month) AS missing_months FROM c GROUP BY ALL""",
    "ag_manifest_sum": "SELECT market, symbol, timeframe, count(DISTINCT archive_object) AS objects, count(*) AS lines, sum(length(raw_line))::BIGINT AS characters FROM raw_klines GROUP BY ALL",
    "so_except": """SELECT *, 'panel' AS side FROM (SELECT market, symbol FROM panel EXCEPT SELECT market, symbol FROM klines)
UNION ALL SELECT *, 'bars' FROM (SELECT market, symbol FROM klines EXCEPT SELECT market, symbol FROM panel)""",
    "so_intersect": "SELECT market, symbol FROM panel INTERSECT SELECT market, symbol FROM funding_events",
    "so_union": "SELECT market, symbol, count(*) AS n FROM (SELECT market, symbol FROM panel UNION ALL SELECT market, symbol FROM funding_events) GROUP BY ALL",
    "so_distinct": "SELECT market, symbol, count(*) AS n FROM (SELECT DISTINCT * FROM panel) GROUP BY ALL",
    "lm_top1": f"WITH {_VOL} SELECT campaign_id, market, universe_month, volume, symbol FROM v WHERE volume >= 0 AND NOT isnan(volume) QUALIFY row_number() OVER (PARTITION BY campaign_id, market, universe_month ORDER BY volume DESC, symbol) = 1",
}
