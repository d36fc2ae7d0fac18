"""Queries of segments, indicators, signals and variants over the bars of klines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.exprs import sdiv
from barloom.operators import cohorts, joins
from barloom.operators.ewm import span, with_ewm
from barloom.operators.indicators import CATALOG, HALO, KEYS, OUTPUTS, indicators, signals, variants
from barloom.operators.segments import chunked, clean_bars, segment_table, segmented
from barloom.operators.slots import SERIES, step_us
from barloom.queries.training import _READ
from barloom.sources.tables import table

KEY = (*SERIES, "slot_no")
#: Quotes and open interest, which no table has, as plain expressions of columns that klines has (the same in SQL below).
CONTEXT = {
    "bid_price": "close - 0.01", "ask_price": "close + 0.01", "bid_qty": "1 + volume", "ask_qty": "1 + trade_count", "open_interest": "1 + volume + trade_count",
}
#: The columns that are joined in: funding as of the bar, the spot market's close of the symbol strictly before it (the
#: reference asset of a futures bar) and the premium over it, and the breadth of the bar's slot.
JOINED = ("funding_rate", "btc_close", "premium", "breadth_pct_above_ema")


def bars(spark: SparkSession, d: str) -> DataFrame:
    return segmented(clean_bars(table(spark, d, "klines"), ["quote_volume", "trade_count", "taker_buy_volume"]))


def above_average(spark: SparkSession, d: str) -> DataFrame:
    """Whether each bar closed above its 50-bar average; NULL during its warm-up."""
    b = with_ewm(chunked(bars(spark, d), HALO), {"ema50": ("close", span(50), 50)}, KEYS, "pos").where("own")
    return b.select(*SERIES, "slot_no", (F.col("close") > F.col("ema50")).alias("above"))


def slot_breadth(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.breadth(above_average(spark, d), ("market", "timeframe", "slot_no"), F.col("above"))


def context_bars(spark: SparkSession, d: str, need=JOINED) -> DataFrame:
    """Bars with CONTEXT and those of JOINED that are needed."""
    b = bars(spark, d)
    at = F.col("slot_no") * step_us(F.col("timeframe"))
    b = b.withColumn("us_", at)
    if "funding_rate" in need:
        e = table(spark, d, "funding_events").where(F.col("funding_rate").isNotNull())
        b = joins.asof(b, "us_", {"f": joins.Source(e, "timestamp", ("funding_rate",), None, ("funding_id",))}, ("market", "symbol"))
        b = b.withColumnRenamed("f_funding_rate", "funding_rate").drop("f_source_us", "f_age_us", "f_coverage")
    if {"btc_close", "premium"} & set(need):
        spot = bars(spark, d).where(F.col("market") == "spot").select("symbol", "timeframe", "close", at.alias("spot_us"))
        b = joins.asof(b, "us_", {"spot": joins.Source(spot, "spot_us", ("close",))}, ("symbol", "timeframe"), strict=True)
        b = b.withColumnRenamed("spot_close", "btc_close").drop("spot_source_us", "spot_age_us", "spot_coverage")
        b = b.withColumn("premium", F.when(F.col("market") != "spot", sdiv(F.col("close"), F.col("btc_close")) - 1))
    if "breadth_pct_above_ema" in need:
        g = slot_breadth(spark, d).select("market", "timeframe", "slot_no", F.col("breadth").alias("breadth_pct_above_ema"))
        b = b.join(g, ["market", "timeframe", "slot_no"], "left")
    return b.drop("us_").withColumns({k: F.expr(e) for k, e in CONTEXT.items()})


def _rounded(df: DataFrame, names) -> list:
    kinds = dict(df.dtypes)
    return [(F.round(c, 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in names]


def seg_ids(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select(*KEY, "segment_id", "segment_start", "pos")


def seg_features(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every series with the gap before it."""
    return segment_table(bars(spark, d))


def _feature(name: str):
    feature = next(f for f in CATALOG if f.name == name)
    outs = feature.outputs

    def query(spark: SparkSession, d: str) -> DataFrame:
        i = indicators(context_bars(spark, d, feature.inputs), [name])
        return i.select(*KEY, *_rounded(i, outs))

    query.__name__ = f"ft_{name}"
    return query


def ft_all(spark: SparkSession, d: str) -> DataFrame:
    """All catalogued indicators in one pass."""
    i = indicators(context_bars(spark, d))
    return i.select(*KEY, *_rounded(i, OUTPUTS))


def sig_all(spark: SparkSession, d: str) -> DataFrame:
    s = signals(indicators(context_bars(spark, d)))
    return s.select(*KEY, *[c for c in s.columns if c.startswith("sig_")])


def sig_variants(spark: SparkSession, d: str) -> DataFrame:
    v = variants(bars(spark, d))
    return v.select(*KEY, *[c for c in v.columns if c.startswith(("ema_", "rsi_", "donchian_", "roc_"))])


QUERIES = {f.__name__: f for f in (seg_ids, seg_features, *(_feature(f.name) for f in CATALOG), ft_all, sig_all, sig_variants)}

BARS_SQL = f"""{_READ},
clean AS (SELECT market, symbol, timeframe, st, slot_no, open_time, open, high, low, close, volume, quote_volume, trade_count, taker_buy_volume FROM reading
  WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL),
grouped AS (SELECT *, slot_no - row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY slot_no) AS grp FROM clean),
bars AS (SELECT *, dense_rank() OVER (PARTITION BY market, symbol, timeframe ORDER BY grp) - 1 AS segment_id,
  min(slot_no) OVER (PARTITION BY market, symbol, timeframe, grp) AS segment_start,
  slot_no - min(slot_no) OVER (PARTITION BY market, symbol, timeframe, grp) AS pos,
  {", ".join(f"({e}) AS {k}" for k, e in CONTEXT.items())} FROM grouped)
"""
_S = "(PARTITION BY market, symbol, timeframe, segment_id ORDER BY pos"
_K = "market, symbol, timeframe, slot_no"


def _roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_S} ROWS {n - 1} PRECEDING) = n_{n} THEN {f}({x}) OVER {_S} ROWS {n - 1} PRECEDING) END".replace(f"n_{n}", str(n))


def _z(x: str) -> str:
    return f"round(({x} - ({_roll('avg', x, 90)})) / nullif({_roll('stddev_pop', x, 90)}, 0), 6)"


def _sql(columns: str, source: str = "bars", more: str = "", base: str = "") -> str:
    columns = columns.replace(", 6) AS", ", 6) + 0.0 AS")  # no negative zeros
    return f"WITH RECURSIVE {base or BARS_SQL}{more}\nSELECT {_K}, {columns} FROM {source}"


#: Steps and averages by recursion over the bars of a segment; x is what averages start from.
_STEPS = f""",
steps0 AS (SELECT *, lag(close) OVER s AS c1, lag(high) OVER s AS h1, lag(low) OVER s AS l1 FROM bars WINDOW s AS {_S})),
steps1 AS (SELECT *, close - c1 AS ch, CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END AS dmu,
  CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END AS dmd, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr FROM steps0)
"""


def _ema(names: dict[str, tuple[str, str, int, int]]) -> str:
    """Recursive averages: name -> (input, smoothing, first pos of the input, pos of the first value shown)."""
    seed = ", ".join(f"CASE WHEN {first} = 0 THEN {x}::DOUBLE END AS {n}" for n, (x, _, first, _) in names.items())
    step = ", ".join(
        f"CASE WHEN s.pos < {first} THEN NULL WHEN s.pos = {first} THEN s.{x}::DOUBLE ELSE coalesce(e.{n} * (1 - {a}) + {a} * s.{x}, e.{n}, s.{x}) END" for n, (x, a, first, _) in names.items())
    shown = ", ".join(f"CASE WHEN e.pos >= {show} THEN e.{n} END AS {n}" for n, (_, _, _, show) in names.items())
    return _STEPS + f""",
ema AS (SELECT market, symbol, timeframe, segment_id, pos, {seed} FROM steps1 WHERE pos = 0
  UNION ALL SELECT s.market, s.symbol, s.timeframe, s.segment_id, s.pos, {step} FROM ema e JOIN steps1 s
  ON s.market = e.market AND s.symbol = e.symbol AND s.timeframe = e.timeframe AND s.segment_id = e.segment_id AND s.pos = e.pos + 1),
av AS (SELECT b.*, {shown} FROM steps1 b JOIN ema e USING (market, symbol, timeframe, segment_id, pos))
"""


_E = {
    "e10": ("close", "2/11.0::DOUBLE", 0, 9), "e20": ("close", "2/21.0::DOUBLE", 0, 19), "e30": ("close", "2/31.0::DOUBLE", 0, 29), "e50": ("close", "2/51.0::DOUBLE", 0, 49),
    "e200": ("close", "2/201.0::DOUBLE", 0, 199), "atr": ("tr", "1/14.0::DOUBLE", 0, 13),
    "btc200": ("btc_close", "2/201.0::DOUBLE", 0, 0),
}
for _n in (7, 14, 21):
    _E[f"u{_n}"] = ("gain", f"1/{_n}.0::DOUBLE", 1, _n)
    _E[f"d{_n}"] = ("loss", f"1/{_n}.0::DOUBLE", 1, _n)
_STEPS = _STEPS.replace("SELECT *, close - c1 AS ch,", "SELECT *, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss,")


def _with(*names: str) -> str:
    return _ema({n: _E[n] for n in names})


def _rsi(n: int) -> str:
    return f"CASE WHEN u{n} = 0 AND d{n} = 0 THEN 50 WHEN d{n} = 0 THEN 100 WHEN u{n} = 0 THEN 0 ELSE 100 - 100 / (1 + u{n} / d{n}) END"


def _don(n: int) -> str:
    f = f"{_S} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(close) OVER {f} = {n} THEN CASE WHEN close > max(high) OVER {f} THEN 1.0 WHEN close < min(low) OVER {f} THEN -1.0 ELSE 0.0 END END"


_BARS0 = BARS_SQL.replace("bars AS (SELECT *, dense_rank()", "bars0 AS (SELECT *, dense_rank()")
_FUNDED = f"""{_BARS0}, ev AS (SELECT market, symbol, epoch_us("timestamp") AS t, funding_rate FROM funding_events WHERE funding_rate IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY market, symbol, "timestamp" ORDER BY funding_id DESC) = 1),
bars AS (SELECT b.*, ev.funding_rate FROM bars0 b ASOF LEFT JOIN ev ON ev.market = b.market AND ev.symbol = b.symbol AND b.slot_no * b.st >= ev.t)"""
_SPOTTED = f"""{_BARS0}, sp AS (SELECT symbol, timeframe, slot_no AS sn, close AS sc FROM bars0 WHERE market = 'spot'),
bars AS (SELECT b.*, sp.sc AS btc_close, CASE WHEN market <> 'spot' THEN b.close / nullif(sp.sc, 0) - 1 END AS premium FROM bars0 b ASOF LEFT JOIN sp ON sp.symbol = b.symbol AND sp.timeframe = b.timeframe AND b.slot_no > sp.sn)"""
BREADTH = """wide AS (SELECT market, timeframe, slot_no, count(close > e50) AS valid, count(*) FILTER (close > e50) AS over FROM av GROUP BY ALL)"""
_lagc = lambda n: f"lag(close, {n}) OVER {_S})"
_RET = f""",
r1 AS (SELECT *, ln(close) - ln(lag(close) OVER {_S})) AS ret FROM bars WHERE close > 0),
r2 AS (SELECT *, {_roll('stddev_pop', 'ret', 20)} * sqrt(20) AS rv FROM r1),
r3 AS (SELECT *, list(rv) FILTER (rv IS NOT NULL) OVER {_S} ROWS 99 PRECEDING) AS past FROM r2)
"""
_CVD = f""",
n1 AS (SELECT *, 2 * taker_buy_volume - volume AS net FROM bars),
n2 AS (SELECT *, CASE WHEN count(net) OVER {_S}) = pos + 1 THEN sum(net) OVER {_S}) END AS c FROM n1)
"""
_DON20 = f"{_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_TP = "((high + low + close) / 3)"
SQL = {
    "seg_ids": _sql("segment_id, segment_start, pos"),
    "seg_features": f"""WITH {BARS_SQL},
g AS (SELECT market, symbol, timeframe, segment_id, min(slot_no) AS segment_start, max(slot_no) AS segment_end, count(*) AS bars FROM bars GROUP BY ALL)
SELECT *, coalesce(segment_start - lag(segment_end) OVER (PARTITION BY market, symbol, timeframe ORDER BY segment_id) - 1, 0) AS gap_size_bars FROM g""",
    "ft_ema_20_50": _sql("round((e20 - e50) / close, 6) AS ema20_50_spread", "av", _with("e20", "e50")),
    "ft_ema_50_200": _sql("round((e50 - e200) / close, 6) AS ema50_200_spread, sign(e50 - e200)::DOUBLE AS ema50_200_regime", "av", _with("e50", "e200")),
    "ft_ema_slope": _sql(f"round((e20 - lag(e20, 5) OVER {_S})) / (5 * close), 6) AS ema20_slope_5", "av", _with("e20")),
    "ft_kaufman": _sql(
        "round(CASE WHEN er IS NOT NULL THEN least(1, er) END, 6) AS kaufman_er10", "k2",
        f", k1 AS (SELECT *, abs(close - {_lagc(1)}) AS step FROM bars), k2 AS (SELECT *, abs(close - {_lagc(10)}) / nullif({_roll('sum', 'step', 10)}, 0) AS er FROM k1)"),
    "ft_donchian": _sql(f"""round(CASE WHEN count(close) OVER {_DON20} = 20 THEN (close - min(low) OVER {_DON20}) / nullif(max(high) OVER {_DON20} - min(low) OVER {_DON20}, 0) END, 6) AS donchian_range_pos20,
  {_don(20)} AS donchian_breakout20"""),
    "ft_roc": _sql(f"round(close / {_lagc(6)} - 1, 6) AS roc6, round(close / {_lagc(24)} - 1, 6) AS roc24"),
    "ft_rsi": _sql(f"round({_rsi(14)}, 6) AS rsi14", "av", _with("u14", "d14")),
    "ft_atr": _sql("round(atr, 6) AS atr14, round(100 * atr / close, 6) AS natr14", "av", _with("atr")),
    "ft_bb": _sql(f"round(4 * ({_roll('stddev_pop', 'close', 20)}) / ({_roll('avg', 'close', 20)}), 6) AS bb_bandwidth20"),
    "ft_rvol": _sql(f"round(volume / nullif({_roll('avg', 'volume', 20)}, 0), 6) AS rvol20"),
    "ft_vwap": _sql("round(v, 6) AS vwap20, round((close - v) / v, 6) AS vwap_deviation20", "v1",
                    f", v0 AS (SELECT *, {_TP} * volume AS tpv FROM bars), v1 AS (SELECT *, ({_roll('sum', 'tpv', 20)}) / nullif({_roll('sum', 'volume', 20)}, 0) AS v FROM v0)"),
    "ft_taker": _sql("round(taker_buy_volume, 6) AS aggressive_buy_volume, round(volume - taker_buy_volume, 6) AS aggressive_sell_volume, round(taker_buy_volume / nullif(volume - taker_buy_volume, 0), 6) AS taker_buy_sell_ratio"),
    "ft_cvd": _sql(f"round(c, 6) AS cvd, round(c - lag(c, 6) OVER {_S}), 6) AS cvd_slope6", "n2", _CVD),
    "ft_spread": _sql("round(10000 * (ask_price - bid_price) / nullif((ask_price + bid_price) / 2, 0), 6) AS spread_bps"),
    "ft_book": _sql("round((bid_qty - ask_qty) / nullif(bid_qty + ask_qty, 0), 6) AS top_book_imbalance, round((ask_price * bid_qty + bid_price * ask_qty) / nullif(bid_qty + ask_qty, 0), 6) AS microprice"),
    "ft_oi": _sql(f"round(open_interest / nullif(lag(open_interest) OVER {_S}), 0) - 1, 6) AS oi_pct_change"),
    "ft_funding_z": _sql(f"{_z('funding_rate')} AS funding_zscore90", base=_FUNDED),
    "ft_premium_z": _sql(f"{_z('premium')} AS premium_zscore90", base=_SPOTTED),
    "ft_btc": _sql("CASE WHEN (btc_close - b2) / b2 > 0.005 THEN 1.0 WHEN (btc_close - b2) / b2 < -0.005 THEN -1.0 WHEN (btc_close - b2) / b2 IS NOT NULL THEN 0.0 END AS btc_regime", "bt2",
                   _with("btc200") + f", bt2 AS (SELECT *, CASE WHEN count(btc_close) OVER {_S}) >= 200 THEN btc200 END AS b2 FROM av)", _SPOTTED),
    "ft_breadth": _sql("round(over / nullif(valid, 0), 6) AS market_breadth", "(SELECT * FROM av JOIN wide USING (market, timeframe, slot_no))", _with("e50") + ", " + BREADTH),
    "sig_variants": _sql(
        "sign(e10 - e30)::DOUBLE AS ema_10_30, sign(e20 - e50)::DOUBLE AS ema_20_50, sign(e50 - e200)::DOUBLE AS ema_50_200, "
        + ", ".join(f"CASE WHEN r{n} <= 30 THEN 1.0 WHEN r{n} >= 70 THEN -1.0 WHEN r{n} IS NOT NULL THEN 0.0 END AS rsi_{n}_30_70" for n in (7, 14, 21)) + ", "
        + ", ".join(f"{_don(n)} AS donchian_{n}" for n in (20, 48, 55)) + ", "
        + ", ".join(f"sign(close / {_lagc(n)} - 1)::DOUBLE AS roc_{n}" for n in (6, 12, 24)), "rs",
        _with("e10", "e20", "e30", "e50", "e200", "u7", "d7", "u14", "d14", "u21", "d21") + ", rs AS (SELECT *, " + ", ".join(f"{_rsi(n)} AS r{n}" for n in (7, 14, 21)) + " FROM av)"),
}
SQL["ft_rv_pct"] = _sql("round(rv, 6) AS realized_vol20, round(CASE WHEN len(past) = 100 THEN len(list_filter(past, lambda v: v <= rv)) / 100.0 END, 6) AS realized_vol_percentile100", "r3", _RET)
