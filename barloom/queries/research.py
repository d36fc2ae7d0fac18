"""Queries of forward paths, backtests, splits, studies and statistics over the bars of klines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import correlation, sdiv
from barloom.operators import backtest, splits, study
from barloom.operators.indicators import indicators, signals, variants
from barloom.operators.segments import chunked, segment_table
from barloom.operators.slots import SERIES, micros, step_us
from barloom.plans.materialize import measured_broadcast, written
from barloom.sources.tables import table
from barloom.queries.bars import _RET, _S, BARS_SQL, bars, context_bars

RUN = (*SERIES, "segment_id")
H = 4
R = 1 + H


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _spot():
    """Where only long trades are allowed."""
    return F.col("market") == "spot"


def _funded(spark, d):
    """Bars with the funding that falls due within each of them, 0 where none does."""
    b = bars(spark, d)
    steps = F.explode(F.array(*[F.struct(F.lit(t).alias("timeframe"), F.lit(n * 60_000_000).alias("st_")) for t, n in (("1m", 1), ("15m", 15), ("1h", 60), ("4h", 240), ("1d", 1440))]))
    e = table(spark, d, "funding_events").where(F.col("funding_rate").isNotNull()).select("market", "symbol", micros(F.col("timestamp")).alias("us_"), "funding_rate", steps.alias("s_"))
    e = e.groupBy("market", "symbol", F.col("s_.timeframe").alias("timeframe"), F.floor(F.col("us_") / F.col("s_.st_")).alias("slot_no")).agg(F.sum("funding_rate").alias("funding"))
    return b.join(e, [*SERIES, "slot_no"], "left").withColumn("funding", F.coalesce("funding", F.lit(0.0)))


def _ruled(spark, d):
    """Bars with the rule that follows the bar's own direction."""
    rule = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    return _funded(spark, d).withColumn("rule", rule)


def _trades(spark, d):
    return backtest.trades(_ruled(spark, d), "rule", H, long_only=_spot(), funding="funding")


def fw_path(spark, d):
    return _shown(backtest.forward_paths(bars(spark, d), H))


def bt_trades(spark, d):
    return _shown(_trades(spark, d).drop("cost", "pays_funding"))


def bt_excursion(spark, d):
    """Largest favourable and adverse moves of every trade and the bars that reach them."""
    return _shown(_trades(spark, d).select(*RUN, "pos", "direction", "mfe", "mae", "bars_to_mfe", "bars_to_mae"))


def _timeline(spark, d):
    b = written(_ruled(spark, d), "ruled")
    return backtest.timeline(b, backtest.trades(b, "rule", H, long_only=_spot(), funding="funding"), funding="funding")


def bt_timeline(spark, d):
    return _shown(_timeline(spark, d))


def bt_mdd(spark, d):
    """Compounded return and deepest fall of every segment's timeline."""
    return _shown(backtest.drawdown(_timeline(spark, d), RUN, "pos"))


YEAR = 365.0


def bt_risk(spark, d):
    return _shown(backtest.risk(written(_timeline(spark, d), "timeline"), SERIES, YEAR), 5)


def _counted(b, keys):
    return b.groupBy(*keys).agg(F.count("*").alias("bars"))


def bt_summary(spark, d):
    """Every series' trades in figures, with the risk of its timeline."""
    b = written(_ruled(spark, d), "ruled")
    t = written(backtest.trades(b, "rule", H, long_only=_spot(), funding="funding"), "trades")
    r = backtest.risk(written(backtest.timeline(b, t, funding="funding"), "timeline"), SERIES, YEAR).select(*SERIES, "sharpe", "sortino", "maximum_drawdown", "calmar")
    return _shown(backtest.summary(t, SERIES, _counted(b, SERIES)).join(r, list(SERIES)), 5)


def bt_direction(spark, d):
    """The same for long and short trades apart, each with a timeline of its own."""
    b = written(_ruled(spark, d), "ruled")
    t = written(backtest.trades(b, "rule", H, long_only=_spot(), funding="funding").withColumn("side", F.col("direction").cast("int")), "trades")
    both = b.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    keys = [*SERIES, "side"]
    r = backtest.risk(written(backtest.timeline(both, t, funding="funding", keys=(*RUN, "side")), "timeline"), keys, YEAR).select(*keys, "sharpe", "sortino", "maximum_drawdown", "calmar")
    return _shown(backtest.summary(t, keys, _counted(both, keys)).join(r, keys), 5)


def bt_cost_sens(spark, d):
    t = backtest.cost_grid(_trades(spark, d))
    return _shown(t.groupBy(*SERIES, "slippage_bps").agg(F.count("*").alias("trade_count"), F.avg("net_at").alias("mean_net"), F.sum("net_at").alias("sum_net")))


def _by_rule(df, rules):
    """Bars once per rule, the rule's signal in ``rule``: one pass takes the trades of all."""
    kept = [c for c in ("slot_no", "pos", "open", "high", "low", "close", "funding", "fold", "part") if c in df.columns]
    return df.select(*RUN, *kept, F.inline(F.array(*[F.struct(F.lit(r).alias("feature_id"), F.col(r).cast("double").alias("rule")) for r in rules])))


def bt_multi(spark, d):
    """All fourteen rules side by side: their trades in figures per rule and market."""
    s = signals(indicators(context_bars(spark, d)))
    long = _by_rule(s, [c for c in s.columns if c.startswith("sig_")])
    t = backtest.trades(long, "rule", H, long_only=_spot(), keys=(*RUN, "feature_id"))
    return _shown(backtest.summary(written(t, "trades"), ["market", "feature_id"]).drop("exposure"))


RULES = [f"{k}_{x}" for k, xs in (("ema", ("10_30", "20_50", "50_200")), ("rsi", ("7_30_70", "14_30_70", "21_30_70")), ("donchian", (20, 48, 55)), ("roc", (6, 12, 24))) for x in xs]


def _variant_trades(spark, d):
    t = backtest.trades(_by_rule(variants(bars(spark, d)), RULES), "rule", H, long_only=_spot(), keys=(*RUN, "feature_id"))
    return written(t, "variant-trades")


def ag_family(spark, d):
    """The rule variants of each series with the best, median and positive share of their family's returns."""
    s = _variant_trades(spark, d).groupBy(*SERIES, "feature_id").agg(F.count("*").alias("trade_count"), (F.product(1 + F.col("net")) - 1).alias("net_return"))
    s = s.withColumn("parameter_family", F.substring_index("feature_id", "_", 1))
    # A family has the variants registered for it, three here.
    w = Window.partitionBy(*SERIES, "parameter_family")
    x = F.col("net_return")
    return _shown(s.select("*", F.max(x).over(w).alias("family_best"), F.percentile("net_return", F.lit(0.5)).over(w).alias("family_median"), F.avg((x > 0).cast("double")).over(w).alias("family_positive")))


def mo_dsr(spark, d):
    """Deflated Sharpe ratio (per trade) of each rule variant of a series among all of them."""
    g = _variant_trades(spark, d).groupBy(*SERIES, "feature_id").agg(F.count("*").alias("trades"), sdiv(F.avg("net"), F.stddev_pop("net")).alias("sharpe"))
    return _shown(study.deflated_sharpes(g, SERIES, "feature_id", "sharpe", "trades"))


def jn_returns_align(spark, d):
    """Returns of every two variants aligned on the bar they were decided at: shared trades and their correlation."""
    t = _variant_trades(spark, d).select(*RUN, "pos", "feature_id", "net")
    a, b = (t.select(*RUN, "pos", F.col("feature_id").alias(x), F.col("net").alias(f"net_{x}")) for x in ("a", "b"))
    j = a.join(b, [*RUN, "pos"]).where(F.col("a") < F.col("b"))
    return _shown(j.groupBy("market", "timeframe", "a", "b").agg(F.count("*").alias("n"), correlation(F.col("net_a"), F.col("net_b")).alias("corr")), 5)


def sp_wf_select(spark, d):
    """Walk-forward selection over each segment's development part: of the variants that trade in a fold's validation part
    the one with the highest compounded net, and what it then does in the fold's test part."""
    v = variants(bars(spark, d))
    n = segment_table(v).select(*RUN, F.floor(F.col("bars") * F.lit(0.6 + 0.2)).alias("n_"))
    long = _by_rule(splits.growing_folds(v.join(n, list(RUN)), F.col("pos"), F.col("n_")), RULES)
    return _shown(splits.selected(_fold_summaries(long), [*RUN, "fold"], "feature_id", "net_return"))


def _fold_summaries(long):
    keys = (*RUN, "fold", "part", "feature_id")
    t = backtest.trades(long, "rule", H, long_only=_spot(), keys=keys)
    return t.groupBy(*keys).agg(F.count("*").alias("trade_count"), (F.product(1 + F.col("net")) - 1).alias("net_return"))


def bt_baselines(spark, d):
    """Rules to compare with: no position, buy and hold, and the sign of the return before."""
    b = written(_funded(spark, d), "funded")
    w = Window.partitionBy(*RUN, "chunk").orderBy("pos")
    back = chunked(b, 1).withColumn("rule", F.signum(sdiv(F.col("close"), F.lag("close").over(w)) - 1)).where("own").drop("own", "chunk")
    t = backtest.trades(back, "rule", H, long_only=_spot(), funding="funding").groupBy(*SERIES).agg(
        F.count("*").alias("trade_count"), (F.product(1 + F.col("gross")) - 1).alias("gross"), (F.product(1 + F.col("net")) - 1).alias("net"))
    rows = backtest.baselines(b, SERIES, long_only=_spot(), funding="funding").withColumn("trade_count", F.col("trade_count").cast("long"))
    return _shown(rows.unionByName(t.withColumn("feature_id", F.lit("baseline_previous_return_sign"))), 5)


def _when(c="slot_no"):
    return F.timestamp_micros(F.col(c) * step_us(F.col("timeframe")))


def ag_by_year(spark, d):
    return _shown(_trades(spark, d).groupBy("market", F.year(_when()).alias("year")).agg(F.count("*").alias("n"), F.avg("net").alias("mean_net"), F.sum("net").alias("sum_net")))


def ag_by_month(spark, d):
    return _shown(_trades(spark, d).groupBy("market", F.date_format(_when(), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.avg("net").alias("mean_net"), F.sum("net").alias("sum_net")))


def _parted(spark, d):
    b = bars(spark, d)
    n = segment_table(b).select(*RUN, F.col("bars").alias("n_"))
    return splits.chronological(b.join(n, list(RUN)), F.col("pos"), F.col("n_"), 0.6, 0.2, 2)


def sp_chrono(spark, d):
    return _parted(spark, d).groupBy(*RUN, "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def sp_global(spark, d):
    us, step = F.col("slot_no") * step_us(F.col("timeframe")), step_us(F.col("timeframe"))
    c = splits.calendar(bars(spark, d), us, step, 1_609_459_200_000_000, 1_672_531_200_000_000, 24, 86_400_000_000)
    return c.groupBy(*SERIES, "part").agg(F.count("*").alias("n"))


FOLDS = (100, 50, 50, 100, 5)


def sp_walk(spark, d):
    """Rows of each segment in the walk-forward folds over its whole length. A segment has no holes, so a part's rows
    are its positions."""
    folds = splits.fold_table(segment_table(bars(spark, d)), F.col("bars"), *FOLDS)
    return folds.select(*RUN, "fold", "part", (F.col("end") - F.col("first")).alias("n"))


def sp_outer(spark, d):
    """Cuts of each series' rows into train, validation and test, five rows of embargo behind either."""
    n = bars(spark, d).groupBy(*SERIES).agg(F.count("*").alias("n"))
    a, b = F.floor(F.col("n") * F.lit(0.6)), F.floor(F.col("n") * F.lit(0.6 + 0.2))
    return n.select(*SERIES, a.alias("train_end"), F.least(a + 5, b).alias("validation_start"), b.alias("validation_end"), F.least(b + 5, F.col("n")).alias("test_start"))


def _feature():
    return sdiv(F.col("close"), F.col("open")) - 1


#: Horizons of the event study, in bars.
HORIZONS = (1, 4)


def _featured(spark, d):
    """Train bars with their feature and validation bars with feature and forward paths over each horizon. Paths do not
    leave the part, so the part's own bars are all they need. The bars are written once, for their parts and all paths."""
    b = written(bars(spark, d).select(*RUN, "slot_no", "pos", "open", "high", "low", "close"), "study-bars")
    n = segment_table(b).select(*RUN, F.col("bars").alias("n_"))
    b = splits.chronological(b.join(measured_broadcast(n), list(RUN)), F.col("pos"), F.col("n_"), 0.6, 0.2, 2).withColumn("feature", _feature())
    v, paths = b.where(F.col("part") == "validation"), None
    for h in HORIZONS:
        f = backtest.forward_paths(v, h, keep=["n_", "feature"]).withColumn("horizon", F.lit(h))
        paths = f if paths is None else paths.unionByName(f)
    paths = paths.where(F.col("pos") + F.col("horizon") < F.floor(F.col("n_") * F.lit(0.6 + 0.2)))
    return b.where(F.col("part") == "train").select(*SERIES, "feature"), paths.drop(*RUN[len(SERIES):], "pos", "entry", "n_")


def mo_qfit(spark, d):
    """Quintile edges of the train part of each series."""
    m = study.fit_quantiles(_parted(spark, d).where(F.col("part") == "train").withColumn("feature", _feature()), SERIES, "feature", 5)
    return m.select(*SERIES, F.posexplode("edges").alias("k", "edge")).withColumn("edge", F.round("edge", 9) + F.lit(0.0))


def mo_qapply(spark, d):
    """How validation and test values fall into the quantiles of the train part."""
    p = _parted(spark, d).withColumn("feature", _feature())
    m = study.fit_quantiles(p.where(F.col("part") == "train"), SERIES, "feature", 5)
    return study.apply_quantiles(p, m, SERIES, "feature").groupBy(*SERIES, "part", "quantile").agg(F.count("*").alias("n"))


STUDY = (*SERIES, "horizon")


def _study(spark, d):
    train, paths = _featured(spark, d)
    v = written(study.apply_quantiles(paths, study.fit_quantiles(train, SERIES, "feature", 5), SERIES, "feature"), "study")
    s = study.event_study(v, STUDY, "feature", "ret")
    ci = study.bootstrap_blocks(v, STUDY, "ret", "slot_no").select(*STUDY, F.lit("overall").alias("slice"), F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    return s.join(ci, [*STUDY, "slice"], "left")


def mo_study(spark, d):
    """Event study of the validation part: the next bars' return by slices of the bar's own return."""
    return _shown(_study(spark, d))


def mo_rank(spark, d):
    """Monotonicity of the study's quantiles."""
    return study.monotonicity(_study(spark, d), STUDY).withColumn("monotonicity", F.round("monotonicity", 6))


INPUTS = ("realized_vol20", "quote_volume", "btc_regime", "market_breadth", "oi_pct_change", "funding_zscore90")


def _regimes(spark, d):
    v = indicators(context_bars(spark, d), ["rv_pct", "btc", "breadth", "oi", "funding_z"]).select(*RUN, "slot_no", "pos", *INPUTS)
    v = written(v, "regime-inputs")
    n = segment_table(v).select(*RUN, F.col("bars").alias("n_"))
    v = splits.chronological(v.join(n, list(RUN)), F.col("pos"), F.col("n_"), 0.6, 0.2)
    return study.regimes(v, study.fit_regimes(v.where(F.col("part") == "train"), SERIES), SERIES)


def mo_regime_fit(spark, d):
    """Thresholds of each series' train part: volatility quantiles and volume terciles."""
    v = indicators(bars(spark, d), ["rv_pct"])
    n = segment_table(v).select(*RUN, F.col("bars").alias("n_"))
    v = splits.chronological(v.join(n, list(RUN)), F.col("pos"), F.col("n_"), 0.6, 0.2)
    t = study.fit_regimes(v.where(F.col("part") == "train").select(*SERIES, "realized_vol20", "quote_volume"), SERIES)
    return t.select(*SERIES, *[F.round(F.col(c)[i], 6).alias(f"{c[0]}{i}") for c, k in (("vol_edges", 3), ("qv_edges", 2)) for i in range(k)])


def _melted():
    return F.inline(F.array(*[F.struct(F.lit(c).alias("regime_type"), F.col(c).alias("regime")) for c in study.REGIMES]))


def mo_regime(spark, d):
    return _regimes(spark, d).select(*SERIES, _melted()).groupBy(*SERIES, "regime_type", "regime").agg(F.count("*").alias("n"))


def ag_regime(spark, d):
    """Trades by the six regimes of their entry bar."""
    r = _regimes(spark, d).select(*RUN, (F.col("pos") - 1).alias("pos"), *study.REGIMES)
    t = _trades(spark, d).join(r, [*RUN, "pos"])
    return _shown(t.select("market", "net", _melted()).groupBy("market", "regime_type", "regime").agg(F.count("*").alias("n"), F.avg("net").alias("mean_net"), F.sum("net").alias("sum_net")))


COLUMNS = ("open", "high", "low", "close", "volume")


def mo_corr(spark, d):
    return _shown(study.correlation_pairs(bars(spark, d), SERIES, COLUMNS), 5)


def mo_overlap(spark, d):
    b = bars(spark, d).select(*SERIES, (F.col("close") > F.col("open")).cast("int").alias("up"), (F.col("volume") > 1000).cast("int").alias("busy"), (F.col("high") == F.col("low")).cast("int").alias("flat"))
    return _shown(study.overlap_pairs(b, SERIES, ("up", "busy", "flat")))


def mo_overlap_signals(spark, d):
    """Overlap of every two of the fourteen rules by series."""
    s = signals(indicators(context_bars(spark, d)))
    return _shown(study.overlap_pairs(s, SERIES, [c for c in s.columns if c.startswith("sig_")]))


RANKED = ("ema20_50_spread", "rsi14", "roc6", "natr14", "rvol20", "vwap_deviation20")


def _rank_pairs(spark, d):
    f = indicators(bars(spark, d), ["ema_20_50", "rsi", "roc", "atr", "rvol", "vwap"]).select("market", "timeframe", *RANKED)
    return study.rank_correlation_pairs(f, ["market", "timeframe"], RANKED)


def mo_corr_rank(spark, d):
    """Rank correlation of the continuous indicators, pair by pair over their complete rows."""
    return _shown(_rank_pairs(spark, d), 4)


def mo_cluster(spark, d):
    """Clusters of these indicators by the absolute rank correlation."""
    return study.cluster_pairs(_rank_pairs(spark, d), ["market", "timeframe"])


def mo_boot(spark, d):
    """Interval of each series' mean bar return by a moving-block bootstrap."""
    b = bars(spark, d).withColumn("r", _feature())
    return _shown(study.bootstrap_blocks(b, SERIES, "r", "slot_no"), 8)


def mo_stability(spark, d):
    """Stability of mean net over holding periods."""
    parts = None
    b = _ruled(spark, d)
    for h in (2, 4, 8):
        t = backtest.trades(b, "rule", h, long_only=_spot()).groupBy("market").agg(F.avg("net").alias("score")).withColumn("holding", F.lit(h))
        parts = t if parts is None else parts.unionByName(t)
    return _shown(study.stability(parts, ["market"], "holding", "score"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.startswith(("fw_", "bt_", "ag_", "sp_", "mo_", "jn_"))}

_K = "market, symbol, timeframe, segment_id"
_F4 = f"{_S} ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)"
_PATH = f"""path AS (SELECT {_K}, slot_no, pos, CASE WHEN lead(open, 1) OVER {_S}) > 0 THEN lead(open, 1) OVER {_S}) END AS e, lead(close, {H}) OVER {_S}) AS c,
  list(high) OVER {_F4} AS hs, list(low) OVER {_F4} AS ls FROM bars),
path2 AS (SELECT {_K}, slot_no, pos, CASE WHEN c IS NOT NULL THEN e END AS entry, CASE WHEN e IS NOT NULL THEN c / e - 1 END AS ret,
  CASE WHEN c IS NOT NULL THEN list_max(hs) / e - 1 END AS mfe, CASE WHEN c IS NOT NULL THEN list_min(ls) / e - 1 END AS mae,
  CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN list_position(hs, list_max(hs))::BIGINT END AS bars_to_mfe, CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN list_position(ls, list_min(ls))::BIGINT END AS bars_to_mae FROM path)"""


def _r(c: str, n: int = 6) -> str:
    return f"round({c}, {n}) + 0.0"


_TRADES = f"""fe AS (SELECT b.market, b.symbol, b.timeframe, epoch_us(e."timestamp") // b.st AS slot_no, sum(e.funding_rate) AS fund FROM (SELECT DISTINCT market, symbol, timeframe, st FROM bars) b
  JOIN funding_events e ON e.market = b.market AND e.symbol = b.symbol AND e.funding_rate IS NOT NULL GROUP BY ALL),
fb AS (SELECT b.*, coalesce(fund, 0) AS fund, CASE WHEN close > open THEN 1.0 WHEN close < open THEN -1.0 ELSE 0.0 END AS rule, sign(close / nullif(lag(close) OVER {_S}), 0) - 1) AS back FROM bars b LEFT JOIN fe USING (market, symbol, timeframe, slot_no))"""


def _taken(rule: str = "rule") -> str:
    return f"""{_TRADES},
cand0 AS (SELECT *, CASE WHEN market = 'spot' THEN greatest(coalesce({rule}, 0), 0) ELSE coalesce({rule}, 0) END AS direction, lead(open, 1) OVER {_S}) AS e, lead(open, {R}) OVER {_S}) AS x,
  sum(fund) OVER {_F4} AS paid, list(high) OVER {_F4} AS hs, list(low) OVER {_F4} AS ls FROM fb),
cand AS (SELECT * FROM cand0 WHERE direction <> 0 AND e > 0 AND x > 0),
ahead AS (SELECT {_K}, pos, min(CASE WHEN direction <> 0 AND e > 0 AND x > 0 THEN pos END) OVER {_S} ROWS BETWEEN {R} FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM cand0),
nxt AS (SELECT c.*, a.np FROM cand c JOIN ahead a USING (market, symbol, timeframe, segment_id, pos)),
chain AS (SELECT {_K}, min(pos) AS pos FROM cand GROUP BY ALL
  UNION ALL SELECT n.market, n.symbol, n.timeframe, n.segment_id, n.np FROM chain c JOIN nxt n ON n.market = c.market AND n.symbol = c.symbol AND n.timeframe = c.timeframe AND n.segment_id = c.segment_id AND n.pos = c.pos WHERE n.np IS NOT NULL),
trades0 AS (SELECT {_K}, slot_no, st, pos, direction, e AS entry, x AS exit, direction * (x / e - 1) AS gross, CASE WHEN market = 'spot' THEN 0 ELSE direction * paid END AS funding,
  greatest(direction * (list_max(hs) / e - 1), direction * (list_min(ls) / e - 1)) AS mfe, least(direction * (list_max(hs) / e - 1), direction * (list_min(ls) / e - 1)) AS mae,
  list_position(hs, list_max(hs))::BIGINT AS top, list_position(ls, list_min(ls))::BIGINT AS bottom FROM cand JOIN chain USING (market, symbol, timeframe, segment_id, pos)),
trades AS (SELECT *, gross - 0.0014 - funding AS net, CASE WHEN direction > 0 THEN top ELSE bottom END AS bars_to_mfe, CASE WHEN direction > 0 THEN bottom ELSE top END AS bars_to_mae FROM trades0)"""


_LINE = f"""held AS (SELECT {_K}, direction, pos + 1 AS a, unnest(range(pos + 1, pos + 1 + {H})) AS pos FROM trades),
moves AS (SELECT {_K}, pos, slot_no, CASE WHEN market = 'spot' THEN 0 ELSE fund END AS f, lead(open) OVER {_S}) / nullif(open, 0) - 1 AS r FROM fb)"""
_EARN = f"coalesce(h.direction * (coalesce(m.r, 0) - m.f) - CASE WHEN m.pos = h.a THEN 0.0007 ELSE 0 END - CASE WHEN m.pos = h.a + {H - 1} THEN 0.0007 ELSE 0 END, 0) AS ret"
_LINE += f", line AS (SELECT m.market, m.symbol, m.timeframe, m.segment_id, m.pos, m.slot_no, {_EARN} FROM moves m LEFT JOIN held h USING (market, symbol, timeframe, segment_id, pos))"
_SIDES = f"""lines AS (SELECT m.market, m.symbol, m.timeframe, m.side, m.slot_no, {_EARN} FROM (SELECT *, unnest([1, -1]) AS side FROM moves) m
  LEFT JOIN held h ON h.market = m.market AND h.symbol = m.symbol AND h.timeframe = m.timeframe AND h.segment_id = m.segment_id AND h.pos = m.pos AND h.direction = m.side)"""


def _risk_sql(source: str, keys: str) -> str:
    s = f"(PARTITION BY {keys} ORDER BY slot_no)"
    return f"""q0 AS (SELECT {keys}, slot_no, ret, product(1 + ret) OVER {s} AS v FROM {source}), q1 AS (SELECT *, v / nullif(max(v) OVER {s}, 0) - 1 AS dd FROM q0),
risk AS (SELECT {keys}, count(ret) AS bars, avg(ret) AS mean, stddev_pop(ret) AS deviation, sqrt(avg(least(ret, 0) ** 2)) AS downside, min(dd) AS maximum_drawdown FROM q1 GROUP BY ALL),
risks AS (SELECT *, mean / nullif(deviation, 0) * sqrt(365) AS sharpe, mean / nullif(downside, 0) * sqrt(365) AS sortino, mean * 365 / nullif(abs(maximum_drawdown), 0) AS calmar FROM risk)"""


_W = f"WITH RECURSIVE {BARS_SQL}, "
_PART = f"""sized AS (SELECT *, count(*) OVER (PARTITION BY {_K}) AS n FROM bars),
parted AS (SELECT *, close / nullif(open, 0) - 1 AS feature, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.6::DOUBLE) + 2 THEN 'embargo' WHEN pos < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation'
  WHEN pos < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) + 2 THEN 'embargo' ELSE 'test' END AS part FROM sized),
model AS (SELECT market, symbol, timeframe, list_distinct(quantile_cont(feature, [0.2, 0.4, 0.6, 0.8])) AS edges FROM parted WHERE part = 'train' GROUP BY ALL HAVING count(feature) >= 10)"""
_FIGURES = {
    "turnover": "2.0 * count(net)", "gross_return": "product(1 + gross) - 1", "net_return": "product(1 + net) - 1", "mean_net": "avg(net)", "median_net": "median(net)", "win_rate": "avg((net > 0)::INT)",
    "mean_win": "avg(net) FILTER (net > 0)", "mean_loss": "avg(net) FILTER (net < 0)", "payoff_ratio": "avg(net) FILTER (net > 0) / nullif(abs(avg(net) FILTER (net < 0)), 0)",
    "profit_factor": "sum(net) FILTER (net > 0) / nullif(abs(sum(net) FILTER (net < 0)), 0)", "mean_mfe": "avg(mfe)", "mean_mae": "avg(mae)", "median_holding_bars": f"CASE WHEN count(net) > 0 THEN {H}.0 END",
}
_OUT = ["exposure", *_FIGURES, "cvar5", "sharpe", "sortino", "maximum_drawdown", "calmar"]


def _summary(keys: str, source: str, of: str, trades: str = "trades") -> str:
    figures = ", ".join(f"{e} AS {c}" for c, e in _FIGURES.items())
    return f"""{_W}{_taken()}, {_LINE}, {_SIDES}, {_risk_sql(source, keys)}, tr AS (SELECT *, direction::INT AS side FROM trades),
g AS (SELECT {keys}, count(*) AS trade_count, {figures}, count(*) FILTER (direction > 0) AS longs, count(*) FILTER (direction < 0) AS shorts, quantile_cont(net, 0.05) AS worst FROM tr GROUP BY {keys}),
tail AS (SELECT {keys}, avg(net) AS cvar5 FROM tr JOIN g USING ({keys}) WHERE net <= worst GROUP BY {keys}), of AS (SELECT {keys}, count(*) AS n FROM {of} GROUP BY ALL),
al AS (SELECT o.*, g.* EXCLUDE ({keys}, trade_count, turnover, longs, shorts), coalesce(trade_count, 0) AS trade_count, coalesce(turnover, 0) AS turnover, coalesce(longs, 0) AS longs, coalesce(shorts, 0) AS shorts, cvar5,
  least(1.0, coalesce(trade_count, 0) * {H} / greatest(n, 1)) AS exposure, sharpe, sortino, maximum_drawdown, calmar FROM of o LEFT JOIN g USING ({keys}) LEFT JOIN tail USING ({keys}) JOIN risks USING ({keys}))
SELECT {keys}, trade_count, longs, shorts, CASE WHEN trade_count > 0 THEN 'ANALYZED' ELSE 'INSUFFICIENT EVIDENCE' END AS evidence_status, {", ".join(f"{_r(c, 5)} AS {c}" for c in _OUT)} FROM al"""


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]


def _path_at(h: int) -> str:
    f = f"{_S} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""SELECT *, {h} AS horizon, c / e - 1 AS ret, list_max(hs) / e - 1 AS mfe, list_min(ls) / e - 1 AS mae, list_position(hs, list_max(hs)) AS tm, list_position(ls, list_min(ls)) AS ta FROM (
  SELECT *, CASE WHEN lead(open, 1) OVER {_S}) > 0 THEN lead(open, 1) OVER {_S}) END AS e, lead(close, {h}) OVER {_S}) AS c, list(high) OVER {f} AS hs, list(low) OVER {f} AS ls FROM parted)
  WHERE part = 'validation' AND pos + {h} < floor(n * (0.6::DOUBLE + 0.2::DOUBLE))"""


_G = "market, symbol, timeframe, horizon"


def _boot(source: str, keys: str, value: str) -> str:
    """The moving-block bootstrap in SQL: draws from the MD5 of keys, sample and draw."""
    hashed = " || '|' || ".join(f"{k}::VARCHAR" for k in keys.split(", "))
    return f"""bv AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY slot_no) - 1 AS i, sum({value}) OVER (PARTITION BY {keys} ORDER BY slot_no) - {value} AS p, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
bt AS (SELECT {keys}, count(*) AS n, sum(v) AS s, greatest(2, floor(sqrt(count(*))))::BIGINT AS b FROM bv GROUP BY ALL),
bp AS (SELECT {keys}, i, p FROM bv UNION ALL SELECT {keys}, n, s FROM bt),
bs AS (SELECT *, unnest(range(0, 200)) AS sample FROM bt WHERE n >= 20 AND n >= 2 * b), bd AS (SELECT *, unnest(range(0, ceil(n / b)::BIGINT)) AS draw FROM bs),
bf AS (SELECT *, floor((('0x' || substr(md5({hashed} || '|' || sample || '|' || draw), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE) * (n - b + 1))::BIGINT AS f FROM bd),
bm AS (SELECT {keys}, sample, sum(z.p - a.p) / any_value(bf.n) AS m FROM bf JOIN bp a USING ({keys}) JOIN bp z USING ({keys}) WHERE a.i = f AND z.i = f + least(b, n - draw * b) GROUP BY ALL),
boot AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY ALL)"""


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


_STUDY = f"""WITH {BARS_SQL}, {_PART}, paths AS ({" UNION ALL ".join(_path_at(h) for h in HORIZONS)}),
cut AS (SELECT p.*, CASE WHEN feature IS NOT NULL THEN len(list_filter(edges, lambda x: x <= feature)) + 1 END AS quantile FROM paths p JOIN model USING (market, symbol, timeframe)),
sliced AS (SELECT {_G}, feature AS x, ret AS y, mfe, mae, tm, ta, unnest(list_filter(['overall', 'quantile_' || quantile, CASE WHEN feature > 0 THEN 'feature_positive' END, CASE WHEN feature < 0 THEN 'feature_negative' END], lambda t: t IS NOT NULL)) AS slice
  FROM cut WHERE feature IS NOT NULL AND ret IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY {_G}, slice ORDER BY x) + (count(*) OVER (PARTITION BY {_G}, slice, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {_G}, slice ORDER BY y) + (count(*) OVER (PARTITION BY {_G}, slice, y) - 1) / 2 AS ry FROM sliced),
study AS (SELECT {_G}, slice, count(*) AS n, avg(y) AS mean_ret, median(y) AS median_ret, avg((y > 0)::INT) AS hit_rate, {_corr('x', 'y')} AS ic, {_corr('rx', 'ry')} AS rank_ic, avg(mfe) AS mean_mfe, avg(mae) AS mean_mae,
  median(tm) AS median_bars_to_mfe, median(ta) AS median_bars_to_mae FROM ranked GROUP BY ALL)"""
_PAIRED = [(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1:]]
SQL = {
    "mo_study": f"""{_STUDY}, {_boot('cut', _G, 'ret')}
SELECT {_G}, slice, n, {", ".join(f"{_r(c)} AS {c}" for c in "mean_ret median_ret hit_rate ic rank_ic mean_mfe mean_mae median_bars_to_mfe median_bars_to_mae".split())},
  CASE WHEN slice = 'overall' THEN {_r('lo')} END AS ci_low, CASE WHEN slice = 'overall' THEN {_r('hi')} END AS ci_high FROM study LEFT JOIN boot USING ({_G})""",
    "mo_rank": f"""{_STUDY}, q AS (SELECT {_G}, replace(slice, 'quantile_', '')::INT AS k, mean_ret FROM study WHERE slice LIKE 'quantile_%'),
r AS (SELECT *, rank() OVER (PARTITION BY {_G} ORDER BY mean_ret) + (count(*) OVER (PARTITION BY {_G}, mean_ret) - 1) / 2 AS rk FROM q) SELECT {_G}, {_r(_corr('k', 'rk'))} AS monotonicity FROM r GROUP BY ALL""",
    "mo_boot": f"""WITH {BARS_SQL}, src AS (SELECT *, close / nullif(open, 0) - 1 AS r FROM bars), {_boot('src', 'market, symbol, timeframe', 'r')}
SELECT market, symbol, timeframe, n, {_r('s / n', 8)} AS mean, {_r('lo', 8)} AS lo, {_r('hi', 8)} AS hi FROM bt LEFT JOIN boot USING (market, symbol, timeframe)""",
    "fw_path": f"WITH {BARS_SQL}, {_PATH} SELECT {_K}, slot_no, pos, {_r('entry')} AS entry, {_r('ret')} AS ret, {_r('mfe')} AS mfe, {_r('mae')} AS mae, bars_to_mfe, bars_to_mae FROM path2",
    "bt_trades": f"{_W}{_taken()} SELECT {_K}, slot_no, pos, direction, {H} AS holding_bars, {', '.join(f'{_r(c)} AS {c}' for c in 'entry exit gross funding net mfe mae'.split())}, 0.001::DOUBLE AS fee, 0.0002::DOUBLE AS spread, 0.0002::DOUBLE AS slippage, bars_to_mfe, bars_to_mae, 0.0007::DOUBLE AS entry_cost, 0.0007::DOUBLE AS exit_cost FROM trades",
    "bt_excursion": f"{_W}{_taken()} SELECT {_K}, pos, direction, {_r('mfe')} AS mfe, {_r('mae')} AS mae, bars_to_mfe, bars_to_mae FROM trades",
    "bt_timeline": f"{_W}{_taken()}, {_LINE} SELECT {_K}, pos, slot_no, {_r('ret')} AS ret FROM line",
    "bt_mdd": f"""{_W}{_taken()}, {_LINE},
eq AS (SELECT {_K}, pos, product(1 + ret) OVER {_S}) AS v FROM line), dd AS (SELECT *, v / nullif(max(v) OVER {_S}), 0) - 1 AS d FROM eq)
SELECT {_K}, {_r('arg_max(v, pos) - 1')} AS compounded, {_r('min(d)')} AS max_drawdown FROM dd GROUP BY ALL""",
    "bt_risk": f"{_W}{_taken()}, {_LINE}, {_risk_sql('line', 'market, symbol, timeframe')} SELECT market, symbol, timeframe, bars, {', '.join(f'{_r(c, 5)} AS {c}' for c in 'mean deviation downside sharpe sortino maximum_drawdown calmar'.split())} FROM risks",
    "bt_summary": _summary("market, symbol, timeframe", "line", "bars"), "bt_direction": _summary("market, symbol, timeframe, side", "lines", "lines"),
    "bt_cost_sens": f"{_W}{_taken()} SELECT market, symbol, timeframe, s::DOUBLE AS slippage_bps, count(*) AS trade_count, {_r('avg(gross - funding - (12 + 2 * s) / 10000)')} AS mean_net, {_r('sum(gross - funding - (12 + 2 * s) / 10000)')} AS sum_net FROM trades CROSS JOIN (VALUES (0), (1), (2), (5)) v(s) GROUP BY ALL",
    "bt_baselines": f"""{_W}{_taken('back')}, hold AS (SELECT market, symbol, timeframe, arg_max(close, slot_no) / nullif(arg_min(open, slot_no), 0) - 1 AS g, sum(CASE WHEN market = 'spot' THEN 0 ELSE fund END) AS f FROM fb GROUP BY ALL)
SELECT market, symbol, timeframe, 'baseline_buy_and_hold' AS feature_id, 1 AS trade_count, {_r('g', 5)} AS gross, {_r('g - 0.0014 - f', 5)} AS net FROM hold
UNION ALL SELECT market, symbol, timeframe, 'baseline_no_position', 0, 0.0, 0.0 FROM hold
UNION ALL SELECT market, symbol, timeframe, 'baseline_previous_return_sign', count(*), {_r('product(1 + gross) - 1', 5)}, {_r('product(1 + net) - 1', 5)} FROM trades GROUP BY ALL""",
    "ag_by_year": f"{_W}{_taken()} SELECT market, year(make_timestamp(slot_no * st))::INT AS year, count(*) AS n, {_r('avg(net)')} AS mean_net, {_r('sum(net)')} AS sum_net FROM trades GROUP BY ALL",
    "ag_by_month": f"{_W}{_taken()} SELECT market, strftime(make_timestamp(slot_no * st), '%Y-%m') AS month, count(*) AS n, {_r('avg(net)')} AS mean_net, {_r('sum(net)')} AS sum_net FROM trades GROUP BY ALL",
    "sp_chrono": f"WITH {BARS_SQL}, {_PART} SELECT {_K}, part, count(*) AS n, min(pos) AS first, max(pos) AS last FROM parted GROUP BY ALL",
    "sp_global": f"""WITH {BARS_SQL} SELECT market, symbol, timeframe, CASE WHEN slot_no * st < 1609459200000000 - 24 * st THEN 'train' WHEN slot_no * st >= 1609459200000000 + 86400000000 AND slot_no * st < 1672531200000000 - 24 * st THEN 'validation'
  WHEN slot_no * st >= 1672531200000000 + 86400000000 THEN 'test' ELSE 'purged' END AS part, count(*) AS n FROM bars GROUP BY ALL""",
    "sp_outer": f"WITH {BARS_SQL}, g AS (SELECT market, symbol, timeframe, count(*) AS n FROM bars GROUP BY ALL), c AS (SELECT *, floor(n * 0.6::DOUBLE)::BIGINT AS a, floor(n * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT AS b FROM g) SELECT market, symbol, timeframe, a AS train_end, least(a + 5, b) AS validation_start, b AS validation_end, least(b + 5, n) AS test_start FROM c",
    "sp_walk": f"""WITH {BARS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY {_K}) AS bars FROM bars),
folds AS (SELECT k::INT AS fold, 100 + 100 * k AS a FROM range(0, (SELECT max(bars) FROM sized) // 100 + 1) t(k)),
tagged AS (SELECT {_K}, fold, CASE WHEN pos < a THEN 'train' WHEN pos >= a + 5 AND pos < a + 55 THEN 'validation' WHEN pos >= a + 60 AND pos < a + 110 THEN 'test' END AS part FROM sized JOIN folds ON a + 110 <= bars)
SELECT {_K}, fold, part, count(*) AS n FROM tagged WHERE part IS NOT NULL GROUP BY ALL""",
    "mo_qfit": f"WITH {BARS_SQL}, {_PART} SELECT market, symbol, timeframe, unnest(range(len(edges)))::INT AS k, round(unnest(list_sort(edges)), 9) + 0.0 AS edge FROM model",
    "mo_qapply": f"""WITH {BARS_SQL}, {_PART} SELECT p.market, p.symbol, p.timeframe, part, CASE WHEN feature IS NOT NULL THEN len(list_filter(edges, lambda e: e <= feature)) + 1 END::INT AS quantile, count(*) AS n
FROM parted p JOIN model m ON m.market = p.market AND m.symbol = p.symbol AND m.timeframe = p.timeframe GROUP BY ALL""",
    "mo_regime_fit": f"""WITH {BARS_SQL}{_RET}, sized AS (SELECT r3.*, count(*) OVER (PARTITION BY {_K}) AS n FROM r3), train AS (SELECT * FROM sized WHERE pos < floor(n * 0.6::DOUBLE)),
q AS (SELECT market, symbol, timeframe, quantile_cont(rv, [0.25, 0.75, 0.95]) AS v, quantile_cont(quote_volume, [0.3333333333333333::DOUBLE, 0.6666666666666666::DOUBLE]) AS q FROM train GROUP BY ALL HAVING count(rv) >= 20 AND count(quote_volume) >= 20)
SELECT market, symbol, timeframe, round(v[1], 6) AS v0, round(v[2], 6) AS v1, round(v[3], 6) AS v2, round(q[1], 6) AS q0, round(q[2], 6) AS q1 FROM q""",
    "mo_corr": f"WITH {BARS_SQL}, " + "c AS (SELECT market, symbol, timeframe, unnest([" + ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'n': count(*), 'corr': CASE WHEN count(*) >= 20 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN {_r(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)', 5)} END}}" for a, b in _PAIRS)
    + "], recursive := true) FROM bars GROUP BY market, symbol, timeframe) SELECT * FROM c",
    "mo_overlap": f"WITH {BARS_SQL}, s AS (SELECT market, symbol, timeframe, close > open AS up, volume > 1000 AS busy, high = low AS flat FROM bars), c AS (SELECT market, symbol, timeframe, unnest([" + ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'overlap': {_r(f'count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a} OR {b}), 0)')}}}" for a, b in (("up", "busy"), ("up", "flat"), ("busy", "flat")))
    + "], recursive := true) FROM s GROUP BY market, symbol, timeframe) SELECT * FROM c",
}
