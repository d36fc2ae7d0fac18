"""Quantile models, regimes, event studies, correlations, overlap, bootstrap and stability."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import correlation, sdiv
from barloom.operators.ranks import quantiles, rank_and_quantiles, running, uniform, with_rank
from barloom.plans.grouped import map_groups
from barloom.plans.materialize import measured_broadcast, written


def fit_quantiles(train: DataFrame, keys: Sequence[str], value: str, q: int) -> DataFrame:
    """Inner q-quantile edges (linear, distinct) of each key with at least 2q values: keys, edges. Fitted on what
    it is given only; apply_quantiles() never looks at other rows."""
    if q < 2:
        raise ValueError("at least two quantiles")
    g = quantiles(train, keys, value, [k / q for k in range(1, q)], "edges", 2 * q)
    return g.select(*keys, F.array_distinct("edges").alias("edges"))


def apply_quantiles(df: DataFrame, model: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds quantile, from 1: one more than the edges not above the value. NULL values have none."""
    v = F.col(value)
    return df.join(model, list(keys)).withColumn("quantile", F.when(v.isNotNull(), F.size(F.filter("edges", lambda e: e <= v)) + 1)).drop("edges")


# Names of the regimes, from the lowest of a column to the highest.
VOLATILITY, LIQUIDITY = ("low", "normal", "high", "panic_extreme"), ("low", "medium", "high")
REGIMES = ("btc_trend_regime", "volatility_regime", "liquidity_bucket", "breadth_regime", "open_interest_regime", "funding_regime")


def regimes(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], volatility: str = "realized_vol20", volume: str = "quote_volume") -> DataFrame:
    """Adds the six REGIMES of a bar, each ``unavailable`` where its input is missing: volatility and volume by frozen
    thresholds (vol_edges, qv_edges of fit_regimes; a value at an edge belongs below it), the reference asset's trend,
    breadth, the change of open interest and the funding z-score by fixed ones. Inputs that the frame lacks are missing."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    e, q, v, u = F.col("vol_edges"), F.col("qv_edges"), F.col(volatility), F.col(volume)
    btc, breadth, oi, funding = has("btc_regime"), has("market_breadth"), has("oi_pct_change"), has("funding_zscore90")
    known = lambda c, x: F.when(c.isNull(), "unavailable").otherwise(x)
    labels = (
        F.when(btc == 1, "bull").when(btc == 0, "neutral").when(btc == -1, "bear").otherwise("unavailable"),
        F.when(v <= e[0], VOLATILITY[0]).when(v <= e[1], VOLATILITY[1]).when(v <= e[2], VOLATILITY[2]).when(v > e[2], VOLATILITY[3]).otherwise("unavailable"),
        F.when(u <= q[0], LIQUIDITY[0]).when(u <= q[1], LIQUIDITY[1]).when(u > q[1], LIQUIDITY[2]).otherwise("unavailable"),
        known(breadth, F.when(breadth >= 0.6, "broad_bullish").when(breadth <= 0.4, "broad_bearish").otherwise("mixed")),
        known(oi, F.when(oi > 0, "rising").when(oi < 0, "falling").otherwise("flat")),
        known(funding, F.when(funding >= 1, "positive_extreme").when(funding <= -1, "negative_extreme").otherwise("normal")))
    return df.join(thresholds, list(keys), "left").withColumns(dict(zip(REGIMES, labels))).drop("vol_edges", "qv_edges")


def fit_regimes(train: DataFrame, keys: Sequence[str], volatility: str = "realized_vol20", volume: str = "quote_volume", least: int = 20) -> DataFrame:
    """Volatility quantiles .25, .75 and .95 and volume terciles of each key that has ``least`` values of both."""
    v = quantiles(train, keys, volatility, (0.25, 0.75, 0.95), "vol_edges", least).drop("n_")
    return v.join(quantiles(train, keys, volume, (1 / 3, 2 / 3), "qv_edges", least).drop("n_"), list(keys))


def event_study(df: DataFrame, keys: Sequence[str], feature: str, ret: str, quantile: str = "quantile") -> DataFrame:
    """Per key and slice (overall, quantile_k, feature_positive, feature_negative) of the rows with a feature and a
    return: count, mean, median, hit rate, Pearson and rank correlation of feature and return, mean mfe and mae and the
    median bars to them. Add the horizon to the keys to study several. Ranks and medians are cut by ranges of value. A
    quantile must be a range of the feature, as of apply_quantiles(): a feature's rank in a slice is then its rank in the
    key less the same number for all rows, which no correlation sees, so features are ranked once, before the slices."""
    f = F.col(feature)
    d = df.where(f.isNotNull() & F.col(ret).isNotNull())
    tags = F.array_compact(F.array(F.lit("overall"), F.concat(F.lit("quantile_"), F.col(quantile).cast("string")),
                                   F.when(f > 0, "feature_positive"), F.when(f < 0, "feature_negative")))
    d = d.select(*keys, f.alias("x_"), F.col(ret).alias("y_"), "mfe", "mae", "bars_to_mfe", "bars_to_mae", tags.alias("tags_"))
    g = [*keys, "slice"]
    ranked = written(with_rank(d.select(*keys, "x_", "y_", "tags_"), keys, "x_", "rx_").drop("x_"), "ranked")
    ranked = ranked.select(*keys, "rx_", "y_", F.explode("tags_").alias("slice"))
    ranked, medians = rank_and_quantiles(ranked, g, "y_", "ry_", [0.5], "median_")
    rank_ic = ranked.groupBy(*g).agg(correlation(F.col("rx_"), F.col("ry_")).alias("rank_ic"))
    medians = medians.select(*g, F.col("median_")[0].alias("median_ret"))
    d = d.select("*", F.explode("tags_").alias("slice")).drop("tags_")
    # Bars to an extreme are at most the horizon, so their exact medians need a count per bar only.
    out = d.groupBy(*g).agg(
        F.count("*").alias("n"), F.avg("y_").alias("mean_ret"), F.avg((F.col("y_") > 0).cast("double")).alias("hit_rate"),
        correlation(F.col("x_"), F.col("y_")).alias("ic"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"),
        F.percentile("bars_to_mfe", F.lit(0.5)).alias("median_bars_to_mfe"), F.percentile("bars_to_mae", F.lit(0.5)).alias("median_bars_to_mae"))
    out = out.join(rank_ic, g).join(medians, g)
    return out.select(*g, "n", "mean_ret", "hit_rate", "ic", "rank_ic", *[c for c in out.columns if c.startswith(("mean_m", "median_bars"))], "median_ret")


def monotonicity(study: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of quantile number and mean return over the quantile slices of a key, three at least."""
    k = F.regexp_extract("slice", r"^quantile_(\d+)$", 1)
    q = study.where(k != "").select(*keys, k.cast("long").alias("k_"), "mean_ret")
    # A study has a handful of quantiles, so this window is short.
    w = Window.partitionBy(*keys)
    q = q.withColumn("r_", F.rank().over(w.orderBy("mean_ret")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "mean_ret")) - 1) / 2)
    return q.groupBy(*keys).agg(correlation(F.col("k_").cast("double"), F.col("r_").cast("double")).alias("monotonicity"))


def correlation_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], min_periods: int = 20) -> DataFrame:
    """Pearson correlation of every two columns over their complete rows: keys, a, b, n, corr. One aggregate over
    the wide rows, no self-join: all pairs are sums of the same pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    g = df.groupBy(*keys).agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n_{i}"), correlation(F.col(a), F.col(b)).alias(f"c_{i}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{i}").alias("n"), F.col(f"c_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return g.select(*keys, F.inline(rows)).withColumn("corr", F.when(F.col("n") >= min_periods, F.col("corr")))


def rank_correlation_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], min_periods: int = 20) -> DataFrame:
    """Spearman correlation of every two columns: keys, a, b, n, corr. Ranks are those among the pair's complete rows."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x_"), F.col(b).alias("y_")) for i, a in enumerate(columns) for b in columns[i + 1:]]
    d = df.select(*keys, F.inline(F.array(*pairs))).where(F.col("x_").isNotNull() & F.col("y_").isNotNull())
    g = [*keys, "a", "b"]
    d = with_rank(with_rank(d, g, "x_", "rx_"), g, "y_", "ry_").groupBy(*g).agg(F.count("*").alias("n"), correlation(F.col("rx_"), F.col("ry_")).alias("corr"))
    return d.withColumn("corr", F.when(F.col("n") >= min_periods, F.col("corr")))


def cluster_pairs(pairs: DataFrame, keys: Sequence[str], cut: float = 0.35) -> DataFrame:
    """Average-linkage clusters of each key's columns by 1 - abs(corr) of correlation_pairs(), a missing one counting as
    0: keys, name, cluster. A key's matrix is that of its columns, a few dozen."""

    def run(b, first, end):
        out = []
        for a, z in zip(first, end):
            p = b.iloc[a:z]
            names = sorted({*p["a"], *p["b"]})
            at, m = {n: i for i, n in enumerate(names)}, np.ones((len(names), len(names)))
            for x, y, c in zip(p["a"], p["b"], p["corr"].fillna(0.0)):
                m[at[x], at[y]] = m[at[y], at[x]] = 1 - abs(c)
            head = p[list(keys)].iloc[[0] * len(names)].reset_index(drop=True)
            out.append(head.assign(name=names, cluster=clusters(names, m, cut)))
        return pd.concat(out)

    kinds = dict(pairs.dtypes)
    return map_groups(pairs.select(*keys, "a", "b", "corr"), keys, ["a", "b"], run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", name string, cluster int")


def deflated_sharpes(trials: DataFrame, keys: Sequence[str], name: str, sharpe: str, n: str) -> DataFrame:
    """deflated_sharpe() of every trial of a key among all of them: keys, name, sharpe, probability."""

    def run(b, first, end):
        b = b.copy()
        p = []
        for a, z in zip(first, end):
            all_ = [x for x in b[sharpe].iloc[a:z] if x == x and x is not None]
            p += [deflated_sharpe(x, all_, int(k)) if x == x else None for x, k in zip(b[sharpe].iloc[a:z], b[n].iloc[a:z])]
        return b.assign(probability=pd.Series(p, index=b.index, dtype="float64")).drop(columns=[n])

    kinds = dict(trials.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, name, sharpe)) + ", probability double"
    return map_groups(trials.select(*keys, name, sharpe, n), keys, [name], run, ddl)


def overlap_pairs(df: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Jaccard overlap of the rows at which two signals are not 0: keys, a, b, overlap; NULL where neither ever is."""
    on = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1:]]
    g = df.groupBy(*keys).agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.count_if(on(a) & on(b)).alias(f"b_{i}"), F.count_if(on(a) | on(b)).alias(f"e_{i}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), sdiv(F.col(f"b_{i}").cast("double"), F.col(f"e_{i}").cast("double")).alias("overlap")) for i, (a, b) in enumerate(pairs)])
    return g.select(*keys, F.inline(rows))


def clusters(names: Sequence[str], distance: np.ndarray, cut: float = 0.35) -> list[int]:
    """Average-linkage clusters of a small matrix (a few dozen names): cluster number per name."""
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        d, i, j = min((float(np.mean([distance[a][b] for a in x for b in y])), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[i] += groups.pop(j)
    out = [0] * len(names)
    for k, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = k
    return out


def bootstrap_mean(values: np.ndarray, block: int, samples: int = 200, confidence: float = 0.95, seed: int = 1729) -> tuple[float, float] | None:
    """Interval of the mean from a moving-block bootstrap; None for fewer than two blocks of values."""
    v = np.asarray(values, float)
    v = v[~np.isnan(v)]
    if block < 1 or samples < 1 or len(v) < 2 * block:
        return None
    rng, n = np.random.default_rng(seed), len(v)
    starts = rng.integers(0, n - block + 1, (samples, math.ceil(n / block)))
    sums = np.concatenate([[0.0], np.cumsum(v)])
    full = n // block
    means = (sums[starts[:, :full] + block] - sums[starts[:, :full]]).sum(axis=1)
    if rest := n - full * block:
        means = means + sums[starts[:, full] + rest] - sums[starts[:, full]]
    lo, hi = np.quantile(means / n, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(lo), float(hi)


#: Draws of the bootstrap that one task makes, some seconds of work.
DRAWS = 500_000


def bootstrap_blocks(
    df: DataFrame, keys: Sequence[str], value: str, order: str, samples: int = 200, confidence: float = 0.95, least: int = 20, whole: int = 16_384,
) -> DataFrame:
    """Interval of each key's mean by a moving-block bootstrap: keys, n, mean, lo, hi; NULL bounds below ``least`` values.

    Blocks of floor(sqrt(n)), two at least, adjacent values (by ``order``, unique within a key) begin anywhere; as many as
    fill n are drawn with replacement, the last one cut short. A block's sum is the difference of two running sums, so
    a draw is two lookups. Draws come from a hash, the same in every run. A key of n values has about samples * sqrt(n)
    draws: below ``whole`` values, where these outnumber the values, the running sums of a key go to one task that draws
    there and no draw is shuffled; a longer key's draws are joined with its sums, so none of its values are gathered.
    """
    keys = list(keys)
    r = written(running(df.where(F.col(value).isNotNull()), keys, order, [value]).drop(order), "prefixes")
    total = written(r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(value).alias("sum_")), "totals")
    b = F.greatest(F.lit(2), F.floor(F.sqrt("n"))).cast("long")
    t = total.where((F.col("n") >= least) & (F.col("n") >= 2 * b)).withColumn("b_", b)
    short = F.col("n") < whole
    cost = F.ceil(F.col("n") / F.col("b_")) * samples
    cost_short, cost_long = t.agg(F.sum(F.when(short, cost)), F.sum(F.when(~short, cost))).first()
    head = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
    p = r.select(*keys, F.col("below").alias("at_"), F.col(f"below_{value}").alias("p_"), F.lit(None).cast("string").alias("head_"))
    p = p.unionByName(total.select(*keys, F.col("n").alias("at_"), F.col("sum_").alias("p_"), head.alias("head_")))
    ci = None
    if cost_short:
        few = p.join(measured_broadcast(total.where(~short).select(*keys)), keys, "left_anti") if cost_long else p
        ci = _drawn_whole(few, keys, samples, confidence, least, min(math.ceil(cost_short / DRAWS), 20_000))
    if cost_long:
        many = p.drop("head_").join(measured_broadcast(total.where(~short).select(*keys)), keys, "left_semi")
        joined = _drawn_joined(many, t.where(~short), keys, samples, confidence, min(math.ceil(cost_long / DRAWS), 20_000))
        ci = joined if ci is None else ci.unionByName(joined)
    if ci is None:
        none = F.lit(None).cast("double")
        return total.select(*keys, "n", (F.col("sum_") / F.col("n")).alias("mean"), none.alias("lo"), none.alias("hi"))
    return total.join(ci, keys, "left").select(*keys, "n", (F.col("sum_") / F.col("n")).alias("mean"), "lo", "hi")


def _drawn_whole(p: DataFrame, keys: list[str], samples: int, confidence: float, least: int, tasks: int) -> DataFrame:
    """Bounds of keys whose running sums p_ (by at_, from 0 to n; head_ of the hash at n) one task holds: keys, lo, hi."""
    at = [(samples - 1) * (1 - confidence) / 2, (samples - 1) * (1 + confidence) / 2]

    def run(b, first, end):
        sums, ends, heads = b["p_"].to_numpy(float), b["at_"].to_numpy(), b["head_"].to_numpy()
        rows, out = [], []
        for a, z in zip(first, end):
            n = int(ends[z - 1])
            size = max(2, math.isqrt(n))
            if n < least or n < 2 * size:
                continue
            p, draws, head = sums[a:z], -(-n // size), heads[z - 1].encode()
            tails = [b"|%d" % k for k in range(draws)]
            text = b"".join([hashlib.md5(s + k, usedforsecurity=False).digest() for s in [head + b"%d" % i for i in range(samples)] for k in tails])
            # The first 13 digits of a hash, as in uniform().
            u = (np.frombuffer(text, ">u8")[::2] >> np.uint64(12)).astype(float) / 2.0**52
            start = np.floor(u * (n - size + 1)).astype(np.int64).reshape(samples, draws)
            stop = start + size
            stop[:, -1] = start[:, -1] + n - (draws - 1) * size
            means = np.sort((p[stop] - p[start]).sum(axis=1) / n)
            rows.append(z - 1)
            out.append([means[math.floor(x)] + (means[math.ceil(x)] - means[math.floor(x)]) * (x - math.floor(x)) for x in at])
        q = np.array(out, float).reshape(-1, 2)
        return b[keys].iloc[rows].assign(lo=q[:, 0], hi=q[:, 1])

    kinds = dict(p.dtypes)
    return map_groups(p, keys, ["at_"], run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lo double, hi double", tasks)


def _drawn_joined(p: DataFrame, t: DataFrame, keys: list[str], samples: int, confidence: float, tasks: int) -> DataFrame:
    """Bounds of the keys of ``t`` (n, b_), draws joined with the running sums: keys, lo, hi. Spark takes exploded rows
    for as many as there were before and would broadcast the draws, so both joins are told to merge."""
    draws = t.select(*keys, "n", "b_", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_")).repartition(tasks, *keys, "sample_")
    draws = draws.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("b_")) - 1)).alias("draw_"))
    start = F.floor(uniform(*keys, "sample_", "draw_") * (F.col("n") - F.col("b_") + 1)).cast("long")
    draws = draws.select(*keys, "n", "sample_", start.alias("from_"), (start + F.least(F.col("b_"), F.col("n") - F.col("draw_") * F.col("b_"))).alias("to_"))
    a, z = (p.select(*keys, F.col("at_").alias(c), F.col("p_").alias(f"p{c}")).hint("merge") for c in ("from_", "to_"))
    m = draws.join(a, [*keys, "from_"]).join(z, [*keys, "to_"]).groupBy(*keys, "n", "sample_").agg((F.sum(F.col("pto_") - F.col("pfrom_"))).alias("s_"))
    q = F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))
    ci = m.groupBy(*keys).agg(F.percentile(F.col("s_") / F.col("n"), q).alias("q_"))
    return ci.select(*keys, F.col("q_")[0].alias("lo"), F.col("q_")[1].alias("hi"))


def deflated_sharpe(sharpe: float, trials: Sequence[float], n: int, skew: float = 0.0, kurtosis: float = 3.0) -> float | None:
    """Probability that a Sharpe ratio exceeds the best of so many trials by luck; None where undefined."""
    k, sd = len(trials), float(np.std(trials, ddof=1)) if len(trials) > 1 else 0.0
    if n < 3 or k < 2 or not sd:
        return None
    z, euler = NormalDist(), 0.5772156649015329
    best = sd * ((1 - euler) * z.inv_cdf(1 - 1 / k) + euler * z.inv_cdf(1 - 1 / (k * math.e)))
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return z.cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else None


def stability(table: DataFrame, keys: Sequence[str], parameter: str, score: str) -> DataFrame:
    """Per key: the best parameter and score, median score, share above 0, and best against median."""
    g = table.groupBy(*keys).agg(
        F.max_by(parameter, F.struct(score, parameter)).alias("best_parameter"), F.max(score).alias("best"), F.percentile(score, F.lit(0.5)).alias("median"),
        F.avg((F.col(score) > 0).cast("double")).alias("positive_share"))
    return g.withColumn("best_to_median", F.abs("best") / F.greatest(F.abs("median"), F.lit(1e-12)))
