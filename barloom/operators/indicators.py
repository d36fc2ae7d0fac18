"""Trailing indicators, signals and rule variants of bar series.

Every value at a bar depends on bars of its own segment up to that bar only. Input: bars of segmented(),
one row per slot. Work is split by (series, segment, chunk); a chunk repeats the bars before it that
its longest formula needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import rolling, sdiv, zscore
from barloom.operators.ewm import filled_ewm, span, wilder, with_ewm
from barloom.operators.segments import CHUNK, chunked
from barloom.operators.slots import SERIES

KEYS = (*SERIES, "segment_id", "chunk")
#: Bars an average of span 200 needs before what lies further back weighs less than 1e-16.
HALO = 3_800


@dataclass(frozen=True)
class Feature:
    """A catalogued indicator: columns it reads, columns it gives, and its longest window in bars."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    warmup: int
    signal: str | None = None


# Names, inputs, outputs and longest windows of the catalogued indicators, which callers rely on.
CATALOG = (
    Feature("ema_20_50", ("close",), ("ema20_50_spread",), 50, "sig_ema20_50"),
    Feature("ema_50_200", ("close",), ("ema50_200_spread", "ema50_200_regime"), 200, "sig_ema50_200"),
    Feature("ema_slope", ("close",), ("ema20_slope_5",), 25, "sig_ema_slope"),
    Feature("adx_dmi", ("high", "low", "close"), ("adx14", "plus_di14", "minus_di14"), 28, "sig_adx_dmi"),
    Feature("kaufman", ("close",), ("kaufman_er10",), 11, "sig_kaufman_er"),
    Feature("donchian", ("high", "low", "close"), ("donchian_range_pos20", "donchian_breakout20"), 21, "sig_donchian"),
    Feature("roc", ("close",), ("roc6", "roc24"), 25, "sig_roc"),
    Feature("rsi", ("close",), ("rsi14",), 15, "sig_rsi"),
    Feature("atr", ("high", "low", "close"), ("atr14", "natr14"), 14),
    Feature("bb", ("close",), ("bb_bandwidth20",), 20),
    Feature("rv_pct", ("close",), ("realized_vol20", "realized_vol_percentile100"), 120),
    Feature("rvol", ("volume",), ("rvol20",), 20),
    Feature("vwap", ("high", "low", "close", "volume"), ("vwap20", "vwap_deviation20"), 20, "sig_vwap_deviation"),
    Feature("taker", ("volume", "taker_buy_volume"), ("aggressive_buy_volume", "aggressive_sell_volume", "taker_buy_sell_ratio"), 1, "sig_taker_ratio"),
    Feature("cvd", ("volume", "taker_buy_volume"), ("cvd", "cvd_slope6"), 7, "sig_cvd"),
    Feature("spread", ("bid_price", "ask_price"), ("spread_bps",), 1),
    Feature("book", ("bid_price", "ask_price", "bid_qty", "ask_qty"), ("top_book_imbalance", "microprice"), 1, "sig_book_imbalance"),
    Feature("oi", ("open_interest",), ("oi_pct_change",), 2),
    Feature("funding_z", ("funding_rate",), ("funding_zscore90",), 90),
    Feature("premium_z", ("premium",), ("premium_zscore90",), 90),
    Feature("btc", ("btc_close",), ("btc_regime",), 200, "sig_btc_regime"),
    Feature("breadth", ("breadth_pct_above_ema",), ("market_breadth",), 1, "sig_market_breadth"),
)
OUTPUTS = tuple(o for f in CATALOG for o in f.outputs)


def optional(df: DataFrame, name: str) -> Column:
    """The column as a double, or a typed NULL where the frame lacks it."""
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _signum(x: Column) -> Column:
    return F.signum(x)


def true_range(w) -> Column:
    """Largest of the bar's range and its distances from the close before; the range alone for the first bar."""
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def strength(gain: Column, loss: Column) -> Column:
    """Relative strength index of average gains and losses."""
    return (
        F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).when(gain == 0, 0.0)
        .otherwise(100 - 100 / (1 + sdiv(gain, loss))))


def chunks(bars: DataFrame, halo: int, size: int) -> DataFrame:
    return chunked(bars, min(halo, size), size)


def indicators(bars: DataFrame, only: Sequence[str] | None = None, size: int = CHUNK) -> DataFrame:
    """``bars`` (segmented) with the outputs of the catalogued indicators (``only``: of those named).

    Missing optional inputs give NULL outputs. Warm-up rows and rows after a gap are NULL until enough
    bars of the segment are there; a zero denominator gives NULL.
    """
    want = {f.name for f in CATALOG} if only is None else set(only)
    if unknown := want - {f.name for f in CATALOG}:
        raise ValueError(f"unknown indicators: {sorted(unknown)}")
    halo = HALO if want & {"ema_20_50", "ema_50_200", "ema_slope", "adx_dmi", "rsi", "atr", "btc"} else 250
    d = chunks(bars, halo, size)
    carried = list(d.columns)
    w = Window.partitionBy(*KEYS).orderBy("pos")
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    outs: dict[str, Column] = {}
    # Steps that averages start from.
    if want & {"rsi"}:
        change = close - F.lag("close").over(w)
        d = d.withColumn("gain_", F.greatest(change, change * 0)).withColumn("loss_", F.greatest(-change, change * 0))
    if want & {"adx_dmi", "atr"}:
        d = d.withColumn("tr_", true_range(w))
    if "adx_dmi" in want:
        up, down = high - F.lag("high").over(w), F.lag("low").over(w) - low
        d = d.withColumn("dm_up_", F.when((up > down) & (up > 0), up).otherwise(0.0))
        d = d.withColumn("dm_down_", F.when((down > up) & (down > 0), down).otherwise(0.0))
    if "btc" in want:
        d = d.withColumn("btc_", optional(d, "btc_close"))
    ewms: dict[str, tuple[str, float, int]] = {}
    if want & {"ema_20_50", "ema_slope"}:
        ewms["ema20_"] = ("close", span(20), 20)
    if want & {"ema_20_50", "ema_50_200"}:
        ewms["ema50_"] = ("close", span(50), 50)
    if "ema_50_200" in want:
        ewms["ema200_"] = ("close", span(200), 200)
    if "rsi" in want:
        ewms |= {"up14_": ("gain_", wilder(14), 14), "down14_": ("loss_", wilder(14), 14)}
    if want & {"adx_dmi", "atr"}:
        ewms["atr_"] = ("tr_", wilder(14), 14)
    if "adx_dmi" in want:
        ewms |= {"plus_": ("dm_up_", wilder(14), 14), "minus_": ("dm_down_", wilder(14), 14)}
    if ewms:
        d = with_ewm(d, ewms, KEYS, "pos")
    if "adx_dmi" in want:
        d = d.withColumn("plus_di14", 100 * sdiv(F.col("plus_"), F.col("atr_"))).withColumn("minus_di14", 100 * sdiv(F.col("minus_"), F.col("atr_")))
        d = d.withColumn("dx_", 100 * sdiv(F.abs(F.col("plus_di14") - F.col("minus_di14")), F.col("plus_di14") + F.col("minus_di14")))
    # The two averages below may meet missing values inside a run.
    late: dict[str, tuple[str, float, int]] = {}
    if "adx_dmi" in want:
        late["adx14"] = ("dx_", wilder(14), 14)
    if "btc" in want:
        late["btc200_"] = ("btc_", span(200), 200)
    if late:
        d = filled_ewm(d, late, KEYS, "pos")

    if "ema_20_50" in want:
        outs["ema20_50_spread"] = sdiv(F.col("ema20_") - F.col("ema50_"), close)
    if "ema_50_200" in want:
        outs["ema50_200_spread"] = sdiv(F.col("ema50_") - F.col("ema200_"), close)
        outs["ema50_200_regime"] = _signum(F.col("ema50_") - F.col("ema200_"))
    if "ema_slope" in want:
        outs["ema20_slope_5"] = sdiv(F.col("ema20_") - F.lag("ema20_", 5).over(w), 5 * close)
    if "adx_dmi" in want:
        outs |= {c: F.col(c) for c in ("adx14", "plus_di14", "minus_di14")}
    if "kaufman" in want:
        d = d.withColumn("step_", F.abs(close - F.lag("close").over(w)))
        er = sdiv(F.abs(close - F.lag("close", 10).over(w)), rolling(F.sum, F.col("step_"), w, 10))
        outs["kaufman_er10"] = F.when(er.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), er)))
    if "donchian" in want:
        frame = w.rowsBetween(-20, -1)
        full = F.count("close").over(frame) == 20
        top, floor = F.when(full, F.max("high").over(frame)), F.when(full, F.min("low").over(frame))
        outs["donchian_range_pos20"] = sdiv(close - floor, top - floor)
        outs["donchian_breakout20"] = F.when(full, F.when(close > top, 1.0).when(close < floor, -1.0).otherwise(0.0))
    if "roc" in want:
        outs |= {f"roc{n}": sdiv(close, F.lag("close", n).over(w)) - 1 for n in (6, 24)}
    if "rsi" in want:
        outs["rsi14"] = strength(F.col("up14_"), F.col("down14_"))
    if "atr" in want:
        outs |= {"atr14": F.col("atr_"), "natr14": 100 * sdiv(F.col("atr_"), close)}
    if "bb" in want:
        outs["bb_bandwidth20"] = 4 * sdiv(rolling(F.stddev_pop, close, w, 20), rolling(F.avg, close, w, 20))
    if "rv_pct" in want:
        d = d.withColumn("log_", F.when(close > 0, F.ln(F.when(close > 0, close))))
        d = d.withColumn("ret_", F.col("log_") - F.lag("log_").over(w))
        d = d.withColumn("realized_vol20", rolling(F.stddev_pop, F.col("ret_"), w, 20) * (20 ** 0.5))
        d = d.withColumn("past_", F.collect_list("realized_vol20").over(w.rowsBetween(-99, 0)))
        now = F.col("realized_vol20")
        outs["realized_vol20"] = now
        outs["realized_vol_percentile100"] = F.when(
            F.size("past_") == 100, F.size(F.filter("past_", lambda v: v <= now)) / F.lit(100.0))
    if "rvol" in want:
        outs["rvol20"] = sdiv(F.col("volume"), rolling(F.avg, F.col("volume"), w, 20))
    if "vwap" in want:
        typical = (high + low + close) / 3
        d = d.withColumn("vwap20", sdiv(rolling(F.sum, typical * F.col("volume"), w, 20), rolling(F.sum, F.col("volume"), w, 20)))
        outs |= {"vwap20": F.col("vwap20"), "vwap_deviation20": sdiv(close - F.col("vwap20"), F.col("vwap20"))}
    if want & {"taker", "cvd"}:
        buy = optional(d, "taker_buy_volume")
        d = d.withColumn("buy_", buy).withColumn("sell_", F.col("volume") - buy)
    if "taker" in want:
        outs |= {"aggressive_buy_volume": F.col("buy_"), "aggressive_sell_volume": F.col("sell_"), "taker_buy_sell_ratio": sdiv(F.col("buy_"), F.col("sell_"))}
    if "cvd" in want:
        # Runs from the segment's start: what lies before the chunk is added from one row per chunk.
        net = F.col("buy_") - F.col("sell_")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("net_", net).withColumn("lost_", F.when(net.isNull(), 1).otherwise(0))
        totals = d.where("own").groupBy(*KEYS).agg(F.sum("net_").alias("s_"), F.sum("lost_").alias("n_"))
        ws = Window.partitionBy(*SERIES, "segment_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*KEYS, F.coalesce(F.sum("s_").over(ws), F.lit(0.0)).alias("s_"), F.coalesce(F.sum("n_").over(ws), F.lit(0)).alias("n_"))
        d = d.join(totals, list(KEYS))
        inside = F.sum(F.when(F.col("own"), F.col("net_"))).over(upto)
        lost = F.sum(F.when(F.col("own"), F.col("lost_"))).over(upto)
        d = d.withColumn("cvd_own_", F.when((lost + F.col("n_")) == 0, F.coalesce(inside, F.lit(0.0)) + F.col("s_")))
        recent = rolling(F.sum, F.col("net_"), w, 6)
        outs |= {"cvd": F.col("cvd_own_"), "cvd_slope6": F.when(F.col("cvd_own_").isNotNull() & (F.col("pos") >= 6), recent)}
    bid, ask, bq, aq = (optional(d, c) for c in ("bid_price", "ask_price", "bid_qty", "ask_qty"))
    if "spread" in want:
        outs["spread_bps"] = 10_000 * sdiv(ask - bid, (ask + bid) / 2)
    if "book" in want:
        outs |= {"top_book_imbalance": sdiv(bq - aq, bq + aq), "microprice": sdiv(ask * bq + bid * aq, bq + aq)}
    if "oi" in want:
        oi = optional(d, "open_interest")
        outs["oi_pct_change"] = sdiv(oi, F.lag(oi).over(w)) - 1
    if "funding_z" in want:
        outs["funding_zscore90"] = zscore(optional(d, "funding_rate"), w, 90)
    if "premium_z" in want:
        outs["premium_zscore90"] = zscore(optional(d, "premium"), w, 90)
    if "btc" in want:
        off = sdiv(F.col("btc_") - F.col("btc200_"), F.col("btc200_"))
        outs["btc_regime"] = F.when(off > 0.005, 1.0).when(off < -0.005, -1.0).when(off.isNotNull(), 0.0)
    if "breadth" in want:
        outs["market_breadth"] = optional(d, "breadth_pct_above_ema")
    kept = [c for c in carried if c not in ("chunk", "own") and c not in outs]
    return d.select(*kept, *[c.alias(n) for n, c in outs.items()], "own").where("own").drop("own")


def signals(df: DataFrame) -> DataFrame:
    """Adds the fourteen rule signals (1, -1, 0; NULL where an input is NULL) of the indicators in ``df``."""
    c = F.col
    both = lambda a, b, x: F.when(a.isNotNull() & b.isNotNull(), x)
    out = {
        "sig_ema20_50": _signum(c("ema20_50_spread")), "sig_ema50_200": _signum(c("ema50_200_spread")), "sig_ema_slope": _signum(c("ema20_slope_5")),
        "sig_adx_dmi": F.when(c("adx14") >= 20, _signum(c("plus_di14") - c("minus_di14"))).when(c("adx14").isNotNull(), 0.0),
        "sig_kaufman_er": both(c("kaufman_er10"), c("ema20_slope_5"), F.when(c("kaufman_er10") >= 0.3, _signum(c("ema20_slope_5"))).otherwise(0.0)),
        "sig_donchian": c("donchian_breakout20"), "sig_roc": _signum(c("roc24")),
        "sig_rsi": F.when(c("rsi14") <= 30, 1.0).when(c("rsi14") >= 70, -1.0).when(c("rsi14").isNotNull(), 0.0),
        "sig_vwap_deviation": -_signum(c("vwap_deviation20")), "sig_taker_ratio": _signum(c("taker_buy_sell_ratio") - 1),
        "sig_cvd": _signum(c("cvd_slope6")), "sig_book_imbalance": _signum(c("top_book_imbalance")), "sig_btc_regime": c("btc_regime"),
        "sig_market_breadth": F.when(c("market_breadth") >= 0.6, 1.0).when(c("market_breadth") <= 0.4, -1.0).when(c("market_breadth").isNotNull(), 0.0),
    }
    return df.select(*df.columns, *[e.alias(n) for n, e in out.items()])


def variants(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """The twelve preregistered rule variants of segmented bars, each 1, -1, 0 or NULL, within segments."""
    d = chunks(bars, HALO, size)
    carried = [c for c in d.columns if c not in ("chunk", "own")]
    w = Window.partitionBy(*KEYS).orderBy("pos")
    change = F.col("close") - F.lag("close").over(w)
    d = d.withColumn("gain_", F.greatest(change, change * 0)).withColumn("loss_", F.greatest(-change, change * 0))
    ewms = {f"ema{n}_": ("close", span(n), n) for n in (10, 20, 30, 50, 200)}
    ewms |= {f"{k}{n}_": (x, wilder(n), n) for n in (7, 14, 21) for k, x in (("up", "gain_"), ("down", "loss_"))}
    d = with_ewm(d, ewms, KEYS, "pos")
    outs = {f"ema_{a}_{b}": _signum(F.col(f"ema{a}_") - F.col(f"ema{b}_")) for a, b in ((10, 30), (20, 50), (50, 200))}
    for n in (7, 14, 21):
        r = strength(F.col(f"up{n}_"), F.col(f"down{n}_"))
        outs[f"rsi_{n}_30_70"] = F.when(r <= 30, 1.0).when(r >= 70, -1.0).when(r.isNotNull(), 0.0)
    for n in (20, 48, 55):
        f = w.rowsBetween(-n, -1)
        full = F.count("close").over(f) == n
        outs[f"donchian_{n}"] = F.when(full, F.when(F.col("close") > F.max("high").over(f), 1.0).when(F.col("close") < F.min("low").over(f), -1.0).otherwise(0.0))
    for n in (6, 12, 24):
        outs[f"roc_{n}"] = _signum(sdiv(F.col("close"), F.lag("close", n).over(w)) - 1)
    return d.select(*carried, *[e.alias(k) for k, e in outs.items()], "own").where("own").drop("own")
