"""Next-bar rules over bars: forward paths, trades that do not overlap, returns by bar, drawdown, summaries.

A decision at a bar is entered at the open of the next one (plus latency) and left ``holding`` bars later.
Runs are segments, so no trade crosses missing bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import sdiv
from barloom.operators.ranks import quantiles
from barloom.operators.slots import SERIES
from barloom.plans.grouped import map_groups
from barloom.plans.materialize import written

RUN = (*SERIES, "segment_id")
SIZE = 16_384


def ahead_chunks(bars: DataFrame, ahead: int, size: int = SIZE) -> DataFrame:
    """Segmented bars in chunks that borrow the ``ahead`` bars behind them: adds chunk and own."""
    home = F.floor(F.col("pos") / F.lit(size)).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - ahead) / F.lit(size))).cast("long")
    return bars.withColumn("chunk", F.explode(F.sequence(first, home))).withColumn("own", F.col("chunk") == home)


def forward_paths(bars: DataFrame, horizon: int, size: int = SIZE, keep: Sequence[str] = ()) -> DataFrame:
    """RUN, slot_no, pos, the columns ``keep`` of the bar, entry (open of the next bar), ret (close ``horizon`` bars on), mfe and mae (highest high,
    lowest low on the way) and the first bar, from 1, at which each is reached. NULL where the path leaves
    the segment or the entry is 0 or less."""
    b = ahead_chunks(bars, horizon, size)
    w = Window.partitionBy(*RUN, "chunk").orderBy("pos")
    f = w.rowsBetween(1, horizon)
    entry = F.lead("open", 1).over(w)
    b = b.withColumn("entry", F.when(entry > 0, entry)).withColumn("last_", F.lead("close", horizon).over(w))
    b = b.withColumn("hi_", F.collect_list("high").over(f)).withColumn("lo_", F.collect_list("low").over(f))
    whole = F.col("last_").isNotNull() & F.col("entry").isNotNull()
    hi, lo = F.array_max("hi_"), F.array_min("lo_")
    return b.where("own").select(
        *RUN, "slot_no", "pos", *keep, F.when(whole, F.col("entry")).alias("entry"), F.when(whole, F.col("last_") / F.col("entry") - 1).alias("ret"),
        F.when(whole, hi / F.col("entry") - 1).alias("mfe"), F.when(whole, lo / F.col("entry") - 1).alias("mae"),
        F.when(whole, F.array_position("hi_", hi)).alias("bars_to_mfe"), F.when(whole, F.array_position("lo_", lo)).alias("bars_to_mae"))


def non_overlapping(candidates: DataFrame, keys: Sequence[str], pos: str, block: int, size: int = SIZE) -> DataFrame:
    """The candidates that a scan in order of ``pos`` takes when each one taken blocks the following
    ``block`` - 1 positions. Rows are (keys, pos) without repeats; the rest of their columns are kept.

    The scan is sequential, but a chunk of positions only needs to know how far the chunk before blocks it,
    a number below ``block``. Each chunk first reports its outcome for every such number; the
    chunks of one run are then threaded on that summary, and each chunk scans once, all in parallel.
    """
    # Read twice, by the chunks' summaries and by the scan: written once, what precedes runs once.
    c = written(candidates.withColumn("chunk_", F.floor(F.col(pos) / F.lit(size)).cast("long")), "candidates")
    kinds, columns = dict(c.dtypes), list(candidates.columns)
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def outcomes(b: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        at = b[pos].to_numpy() - b["chunk_"].to_numpy() * size
        rows = []
        for a, z in zip(first, end):
            p = at[a:z]
            after = np.searchsorted(p, p + block).tolist()
            # From the last candidate back: how far the next chunk is blocked once this one is taken.
            out = [0] * (z - a + 1)
            for i in range(z - a - 1, -1, -1):
                out[i] = out[after[i]] if after[i] < z - a else max(0, int(p[i]) + block - size)
            rows.append([out[i] for i in np.searchsorted(p, np.arange(block))])
        head = b.iloc[first][[*keys, "chunk_"]].copy()
        head["out_"] = rows
        return head

    def threaded(b: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        chunk, out, starts = b["chunk_"].tolist(), b["out_"].tolist(), []
        for a, z in zip(first, end):
            blocked, before = 0, None
            for k in range(a, z):
                if before is not None and chunk[k] != before + 1:
                    blocked = 0  # a whole chunk without candidates lies between
                starts.append(blocked)
                blocked, before = int(out[k][blocked]), chunk[k]
        b = b[[*keys, "chunk_"]].copy()
        b["free_"] = starts
        return b

    def scanned(b: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        at = b[pos].to_numpy() - b["chunk_"].to_numpy() * size
        # One axis on which groups lie further apart than a choice blocks.
        axis = at + np.repeat(np.arange(len(first)) * (size + 2 * block), end - first)
        after = np.searchsorted(axis, axis + block).tolist()
        free = b["free_"].to_numpy()[first]
        begin = np.searchsorted(axis, np.arange(len(first)) * (size + 2 * block) + free).tolist()
        keep = np.zeros(len(b), bool)
        for i, z in zip(begin, end.tolist()):
            while i < z:
                keep[i] = True
                i = after[i]
        return b.loc[keep, columns]

    if block > size:
        raise ValueError("a chunk must be longer than what a choice blocks")
    chunk_keys = [*keys, "chunk_"]
    summary = map_groups(c.select(*chunk_keys, pos), chunk_keys, [pos], outcomes, f"{key_ddl}, chunk_ long, out_ array<int>")
    free = map_groups(summary, keys, ["chunk_"], threaded, f"{key_ddl}, chunk_ long, free_ long")
    ddl = ", ".join(f"`{x}` {t}" for x, t in candidates.dtypes)
    return map_groups(c.join(free, chunk_keys), chunk_keys, [pos], scanned, ddl)


@dataclass(frozen=True)
class Costs:
    """Costs in basis points: fees a side by mode, the spread assumed where a bar has none, slippage a side; and the
    bars that pass before an order is filled."""

    maker_fee_bps: float = 2.0
    taker_fee_bps: float = 5.0
    spread_bps: float = 2.0
    slippage_bps: float = 1.0
    latency_bars: int = 0

    def fee_bps(self, mode: str) -> float:
        if mode not in ("maker", "taker"):
            raise ValueError("a fee mode is maker or taker")
        return self.maker_fee_bps if mode == "maker" else self.taker_fee_bps

    def round_trip(self, mode: str = "taker") -> float:
        """Fees, spread and slippage of one entry and exit without quotes, as a share."""
        return (2 * self.fee_bps(mode) + self.spread_bps + 2 * self.slippage_bps) / 10_000


def trades(
    bars: DataFrame, signal: str, holding: int = 4, costs: Costs = Costs(), fee_mode: str = "taker", long_only: Column | None = None,
    spread: str | None = None, funding: str | None = None, size: int = SIZE, keys: Sequence[str] = RUN,
) -> DataFrame:
    """Trades of a signal column: keys, decision slot and position, direction, holding_bars, entry, exit, gross, fee, spread,
    slippage, funding, net, mfe, mae and the first bars, from 1, at which these are reached; entry_cost and exit_cost
    are what either side pays.

    NULL and 0 signals decide nothing; where ``long_only`` holds, neither do negative ones. A decision needs both
    opens within the segment and above 0. ``spread`` is a column of basis points, whose NULLs are the assumed spread: half
    is paid at entry, half of the exit bar's at exit. ``funding`` is a column of rates that a position pays (short: earns)
    for every bar from entry up to, not including, exit; outside ``long_only`` a NULL among a taken trade's is an error.
    net = gross - fee - spread - slippage - funding.
    """
    s = F.signum(F.coalesce(F.col(signal).cast("double"), F.lit(0.0)))
    spot = F.lit(False) if long_only is None else long_only
    s = F.when(spot & (s < 0), 0.0).otherwise(s)
    latency, fee = costs.latency_bars, costs.fee_bps(fee_mode)
    reach = 1 + latency + holding
    b = ahead_chunks(bars, reach, size)
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    path = w.rowsBetween(1 + latency, latency + holding)
    quoted = F.coalesce(F.col(spread).cast("double"), F.lit(costs.spread_bps)) if spread else F.lit(costs.spread_bps)
    b = b.withColumn("quoted_", quoted)
    paid = [F.sum(funding).over(path).alias("paid_"), F.count(funding).over(path).alias("known_")] if funding else [F.lit(0.0).alias("paid_"), F.lit(holding).alias("known_")]
    b = b.select(
        *keys, "slot_no", "pos", "own", s.alias("direction"), F.lead("open", 1 + latency).over(w).alias("entry"), F.lead("open", reach).over(w).alias("exit"),
        F.lead("quoted_", 1 + latency).over(w).alias("s_in_"), F.lead("quoted_", reach).over(w).alias("s_out_"), spot.alias("spot_"), *paid,
        F.collect_list("high").over(path).alias("hi_"), F.collect_list("low").over(path).alias("lo_"))
    b = b.where(F.col("own") & (F.col("direction") != 0) & (F.col("entry") > 0) & (F.col("exit") > 0)).drop("own")
    t = non_overlapping(b, keys, "pos", reach, size)
    if funding:
        gap = ~F.col("spot_") & (F.col("known_") < holding)
        t = t.where(F.when(gap, F.raise_error(F.lit("a futures trade without funding"))).otherwise(F.lit(True)))
    d, e = F.col("direction"), F.col("entry")
    top, bottom = F.array_max("hi_"), F.array_min("lo_")
    up, down = d * (top / e - 1), d * (bottom / e - 1)
    at_top, at_bottom = F.array_position("hi_", top), F.array_position("lo_", bottom)
    bps = lambda x: x / F.lit(10_000.0)
    side = fee + costs.slippage_bps
    out = t.select(
        *keys, "slot_no", "pos", "direction", (~F.col("spot_")).alias("pays_funding"), F.lit(holding).alias("holding_bars"), "entry", "exit", (d * (F.col("exit") / e - 1)).alias("gross"),
        F.lit(2 * fee / 10_000).alias("fee"), bps((F.col("s_in_") + F.col("s_out_")) / 2).alias("spread"), F.lit(2 * costs.slippage_bps / 10_000).alias("slippage"),
        F.when(F.col("spot_"), 0.0).otherwise(d * F.coalesce("paid_", F.lit(0.0))).alias("funding"), F.greatest(up, down).alias("mfe"), F.least(up, down).alias("mae"),
        F.when(d > 0, at_top).otherwise(at_bottom).alias("bars_to_mfe"), F.when(d > 0, at_bottom).otherwise(at_top).alias("bars_to_mae"),
        bps(side + F.col("s_in_") / 2).alias("entry_cost"), bps(side + F.col("s_out_") / 2).alias("exit_cost"))
    cost = F.col("fee") + F.col("spread") + F.col("slippage")
    return out.withColumn("cost", cost).withColumn("net", F.col("gross") - cost - F.col("funding"))


def timeline(bars: DataFrame, taken: DataFrame, latency: int = 0, funding: str | None = None, size: int = SIZE, keys: Sequence[str] = RUN) -> DataFrame:
    """One return per bar, open to open: keys, pos, slot_no, ret. A bar within a trade earns the trade's direction times
    its return less, off spot, its funding; the trade's first bar pays its entry cost and the last one its exit cost; idle
    bars earn 0."""
    b = ahead_chunks(bars, 1, size)
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    rate = F.coalesce(F.col(funding).cast("double"), F.lit(0.0)) if funding else F.lit(0.0)
    r = b.withColumn("r_", sdiv(F.lead("open").over(w), F.col("open")) - 1).withColumn("f_", rate).where("own").select(*keys, "pos", "slot_no", "r_", "f_")
    first = F.col("pos") + 1 + latency
    held = taken.select(*keys, "direction", "entry_cost", "exit_cost", "holding_bars", F.col("pays_funding").alias("pays_"), first.alias("a_"),
                        F.explode(F.sequence(first, first + F.col("holding_bars") - 1)).alias("pos"))
    pay = F.when(F.col("pos") == F.col("a_"), F.col("entry_cost")).otherwise(0.0) + F.when(F.col("pos") == F.col("a_") + F.col("holding_bars") - 1, F.col("exit_cost")).otherwise(0.0)
    held = held.select(*keys, "pos", "direction", "pays_", pay.alias("pay_"))
    earned = F.col("direction") * (F.coalesce("r_", F.lit(0.0)) - F.when(F.col("pays_"), F.col("f_")).otherwise(0.0)) - F.col("pay_")
    return r.join(held, [*keys, "pos"], "left").select(*keys, "pos", "slot_no", F.coalesce(earned, F.lit(0.0)).alias("ret"))


def drawdown(returns: DataFrame, keys: Sequence[str], order: str, size: int = SIZE) -> DataFrame:
    """Per key: compounded return and deepest fall of the compounded value below its peak (the peak begins with
    the first value). Chunks of ``order`` are compounded on their own; one row per chunk carries value and peak."""
    r = returns.withColumn("chunk_", F.floor(F.col(order) / F.lit(size)).cast("long"))
    w = Window.partitionBy(*keys, "chunk_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.select(*keys, "chunk_", order, F.product(1 + F.col("ret")).over(w).alias("v_"))
    r = r.withColumn("p_", F.max("v_").over(w))
    c = r.groupBy(*keys, "chunk_").agg(F.max_by("v_", order).alias("end_"), F.max("v_").alias("top_"))
    s = Window.partitionBy(*keys).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("base_", F.coalesce(F.product("end_").over(s), F.lit(1.0)))
    c = c.withColumn("before_", F.max(F.col("base_") * F.col("top_")).over(s)).drop("top_")
    j = r.join(c, [*keys, "chunk_"])
    value = F.col("base_") * F.col("v_")
    peak = F.greatest(F.col("base_") * F.col("p_"), F.col("before_"))
    g = j.groupBy(*keys).agg(F.max_by(value, order).alias("v_"), F.min(sdiv(value, peak) - 1).alias("max_drawdown"))
    return g.select(*keys, (F.col("v_") - 1).alias("compounded"), "max_drawdown")


def risk(returns: DataFrame, keys: Sequence[str], periods_per_year: float, order: str = "slot_no") -> DataFrame:
    """Mean, deviation (population), downside deviation, annual Sharpe and Sortino, maximum_drawdown and Calmar (annual mean
    by the drawdown); NULL at a denominator of 0. NULL returns count as 0."""
    r = returns.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    g = r.groupBy(*keys).agg(F.count("ret").alias("bars"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("deviation"),
                             F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2.0)))).alias("downside"))
    k = periods_per_year ** 0.5
    g = g.withColumn("sharpe", sdiv(F.col("mean"), F.col("deviation")) * k).withColumn("sortino", sdiv(F.col("mean"), F.col("downside")) * k)
    d = drawdown(r, keys, order).select(*keys, F.col("max_drawdown").alias("maximum_drawdown"))
    return g.join(d, list(keys)).withColumn("calmar", sdiv(F.col("mean") * periods_per_year, F.abs("maximum_drawdown")))


def summary(taken: DataFrame, keys: Sequence[str], bars: DataFrame | None = None) -> DataFrame:
    """Per key: trades, exposure and turnover, compounded gross and net, mean and median net, win rate, mean win and loss,
    payoff ratio, profit factor, mean of the worst twentieth, mean mfe and mae, median holding, longs and shorts.

    ``bars`` (keys, bars) are the keys to report and their numbers of bars: one without a trade comes out with 0 trades
    and INSUFFICIENT EVIDENCE, the others with ANALYZED. Without it exposure is NULL and only keys with trades are there.
    """
    wins, losses = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, F.col("net"))
    g = taken.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), (2.0 * F.count("*")).alias("turnover"), (F.product(1 + F.col("gross")) - 1).alias("gross_return"), (F.product(1 + F.col("net")) - 1).alias("net_return"),
        F.avg("net").alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg(wins).alias("mean_win"), F.avg(losses).alias("mean_loss"),
        sdiv(F.avg(wins), F.abs(F.avg(losses))).alias("payoff_ratio"), sdiv(F.sum(wins), F.abs(F.sum(losses))).alias("profit_factor"),
        F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"), F.percentile("holding_bars", F.lit(0.5)).alias("median_holding_bars"),
        F.sum("holding_bars").alias("held_"), F.count_if(F.col("direction") > 0).alias("longs"), F.count_if(F.col("direction") < 0).alias("shorts"))
    q = quantiles(taken, keys, "net", [0.5, 0.05], "q_").select(*keys, F.col("q_")[0].alias("median_net"), F.col("q_")[1].alias("worst_"))
    tail = taken.join(q, list(keys)).where(F.col("net") <= F.col("worst_")).groupBy(*keys).agg(F.avg("net").alias("cvar5"))
    g = g.join(q.drop("worst_"), list(keys), "left").join(tail, list(keys), "left")
    if bars is None:
        return g.withColumn("exposure", F.lit(None).cast("double")).withColumn("evidence_status", F.lit("ANALYZED")).drop("held_")
    g = bars.select(*keys, F.col("bars").alias("of_")).join(g, list(keys), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "turnover", "longs", "shorts")}
    status = F.when(F.col("trade_count") > 0, "ANALYZED").otherwise("INSUFFICIENT EVIDENCE")
    exposure = F.least(F.lit(1.0), F.coalesce("held_", F.lit(0)) / F.greatest(F.col("of_"), F.lit(1)))
    return g.withColumns(zero).withColumn("exposure", exposure).withColumn("evidence_status", status).drop("held_", "of_")


def cost_grid(taken: DataFrame, slippages: Sequence[float] = (0, 1, 2, 5)) -> DataFrame:
    """The same trades under several slippages (basis points a side): net_at and slippage_bps per trade and slippage; all
    other costs are the trade's own."""
    at = F.explode(F.array(*[F.lit(float(s)) for s in slippages])).alias("slippage_bps")
    others = F.col("fee") + F.col("spread") + F.col("funding")
    return taken.select("*", at).withColumn("net_at", F.col("gross") - others - 2 * F.col("slippage_bps") / 10_000)


def baselines(bars: DataFrame, keys: Sequence[str], costs: Costs = Costs(), fee_mode: str = "taker", long_only: Column | None = None, funding: str | None = None, order: str = "slot_no") -> DataFrame:
    """Per key the baselines that trade nothing or once: keys, feature_id, trade_count, gross, net. Buying and holding goes
    from the first open to the last close, less one round trip and, outside ``long_only``, the funding of all its bars."""
    spot = F.lit(False) if long_only is None else long_only
    paid = F.sum(F.when(spot, 0.0).otherwise(F.coalesce(F.col(funding), F.lit(0.0)))) if funding else F.lit(0.0)
    g = bars.groupBy(*keys).agg(F.min_by("open", order).alias("a_"), F.max_by("close", order).alias("b_"), paid.alias("paid_"))
    gross = sdiv(F.col("b_"), F.col("a_")) - 1
    row = lambda name, n, x, y: F.struct(F.lit(name).alias("feature_id"), F.lit(n).alias("trade_count"), x.alias("gross"), y.alias("net"))
    return g.select(*keys, F.inline(F.array(
        row("baseline_no_position", 0, F.lit(0.0), F.lit(0.0)), row("baseline_buy_and_hold", 1, gross, gross - F.lit(costs.round_trip(fee_mode)) - F.col("paid_")))))
