"""Indicators against pandas, causality, joins, trades against a greedy loop, statistics, sources, sinks, streams."""

from __future__ import annotations

import hashlib
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, joins, quality, splits, study
from barloom.operators.ewm import filled_ewm, span, with_ewm
from barloom.operators.indicators import CATALOG, indicators, variants
from barloom.operators.normalize import aggressor_side, epoch_micros, epoch_unit, positional
from barloom.operators.resample import compare_native, resample, source_policy
from barloom.operators.segments import segmented
from barloom.operators.slots import readings
from barloom.plans.materialize import measured_broadcast, written
from barloom.sources.archives import ArchivePath, read_zip_lines, synthetic_bars
from barloom.sources.sinks import append_record, append_revisions, write_panel, write_tables
from barloom.sources.tables import require_columns
from barloom.streaming.capture import append_log, bars_from_trades, routed

COSTS = backtest.Costs(taker_fee_bps=10, slippage_bps=0, spread_bps=0)


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return [("A", i, float(v), 1, {"open": float(v * (1 + rng.normal(0, 0.002))), "high": float(v * 1.01), "low": float(v * 0.99), "volume": float(rng.uniform(1, 9))}) for i, v in enumerate(c)]


def bars(klines, rows, **kw):
    cols = ["open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_volume"]
    return segmented(readings(klines(rows), cols).drop("own"), **kw)


def test_averages_match_pandas(spark):
    x = pd.Series(np.random.default_rng(1).normal(100, 5, 1500))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, p int, x double")
    got = with_ewm(df, {"e20": ("x", span(20), 20), "e5": ("x", span(5), 1)}, ["k"], "p").orderBy("p").toPandas()
    for name, n, least in (("e20", 20, 20), ("e5", 5, 1)):
        np.testing.assert_allclose(got[name], x.ewm(span=n, adjust=False, min_periods=least).mean(), rtol=1e-12)
    x[5::7] = np.nan
    df = spark.createDataFrame([("a", i, None if v != v else float(v)) for i, v in enumerate(x)], "k string, p int, x double")
    got = filled_ewm(df, {"e": ("x", span(20), 3)}, ["k"], "p").orderBy("p").toPandas()
    np.testing.assert_allclose(got["e"], x.ewm(span=20, adjust=False, min_periods=3).mean(), rtol=1e-12)


def test_chunks_change_nothing(klines):
    b = bars(klines, walk(900))
    names = [f.name for f in CATALOG if f.name not in ("ema_50_200", "btc")]
    whole = indicators(b, names).orderBy("pos").toPandas()
    parts = indicators(b, ["donchian", "rv_pct", "cvd", "vwap", "kaufman"], size=260).orderBy("pos").toPandas()
    assert len(whole) == len(parts) == 900
    for c in ("donchian_range_pos20", "realized_vol_percentile100", "cvd", "cvd_slope6", "vwap20", "kaufman_er10"):
        np.testing.assert_allclose(parts[c].astype(float), whole[c].astype(float), rtol=1e-9, atol=1e-9)


def test_no_value_depends_on_later_bars(klines):
    rows = walk(300)
    more = [(s, i, c * 1000, t, {k: v * 1000 for k, v in m.items()}) for s, i, c, t, m in walk(320)[300:]]
    names = [f.name for f in CATALOG]
    a = indicators(bars(klines, rows), names).orderBy("pos").toPandas()
    b = indicators(bars(klines, rows + more), names).where("pos < 300").orderBy("pos").toPandas()
    for c in a.select_dtypes("number").columns:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12, equal_nan=True)
    v, u = (variants(bars(klines, r)).where("pos < 300").orderBy("pos").toPandas() for r in (rows, rows + more))
    assert v.iloc[:, -12:].equals(u.iloc[:, -12:]) and set(np.unique(v.iloc[:, -12:].to_numpy(float)[250:])) <= {-1.0, 0.0, 1.0}


def test_state_ends_at_a_gap(klines):
    rows = [r for r in walk(120) if r[1] != 60]
    i = indicators(bars(klines, rows), ["ema_20_50", "cvd"]).orderBy("slot_no").toPandas()
    assert i["ema20_50_spread"].notna().tolist() == [k >= 49 for k in range(60)] + [k >= 49 for k in range(59)]
    r = rows[60]
    assert i["pos"].iloc[60] == 0 and i["cvd"].iloc[60] == pytest.approx(2 * 0.5 - r[4]["volume"])


def test_adx_against_a_loop(klines):
    rows = walk(80, 3)
    i = indicators(bars(klines, rows), ["adx_dmi"]).orderBy("pos").toPandas()
    p = pd.DataFrame([m | {"close": c} for _, _, c, _, m in rows])
    up, down, pc = p.high.diff(), -p.low.diff(), p.close.shift()
    tr = pd.concat([p.high - p.low, (p.high - pc).abs(), (p.low - pc).abs()], axis=1).max(axis=1)
    w = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    di = [100 * w(x.where((x > y) & (x > 0), 0.0)) / w(tr) for x, y in ((up, down), (down, up))]
    dx = 100 * (di[0] - di[1]).abs() / (di[0] + di[1])
    np.testing.assert_allclose(i["adx14"].astype(float), w(dx), rtol=1e-9)


def test_resample_keeps_complete_buckets(klines):
    b = bars(klines, [r for r in walk(200) if r[1] not in (70, 130)])
    r = resample(b, 3_600_000_000).orderBy("bucket").toPandas()
    assert len(r) == 1 and r["bars"].tolist() == [60]
    n = resample(b, 3_600_000_000)
    c = compare_native(n, n.withColumn("close", F.col("close") + 1), ("market", "symbol", "bucket"), ("open", "close", "trade_count"))
    assert {x.field: x.status for x in c.collect()} == {"open": "MATCH", "close": "MISMATCH", "trade_count": "MATCH"}
    assert source_policy(c, ("market", "symbol")).first().policy == "RESAMPLED"


def test_asof_ties_staleness_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 25), (3, "b", 10), (4, None, 10), (5, "a", 1), (6, "a", None)], "id int, k string, t long")
    obs = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 12, None, 3), ("a", 30, 9.0, 4)], "k string, t long, v double, n int")
    for spans in (8, 1000):
        r = {x.id: x for x in joins.asof(left, "t", {"o": joins.Source(obs, "t", ("v",), 5, ("n",))}, ["k"], span_us=spans).collect()}
        assert (r[1].o_v, r[1].o_coverage) == (2.0, "AVAILABLE") and (r[2].o_v, r[2].o_source_us, r[2].o_coverage) == (None, 12, "STALE")
        assert {r[i].o_coverage for i in (3, 4, 5, 6)} == {"NO_PRIOR_OBSERVATION"}
        s = {x.id: x for x in joins.asof(left, "t", {"o": joins.Source(obs, "t", ("v",), None, ("n",))}, ["k"], strict=True, span_us=spans).collect()}
        assert s[1].o_coverage == "NO_PRIOR_OBSERVATION" and s[2].o_source_us == 12 and s[2].o_v is None


@pytest.mark.parametrize("size", [16, 16_384])
def test_greedy_choice_in_chunks(spark, size):
    rng = random.Random(size)
    rows = [(k, p) for k in "abc" for p in range(200) if rng.random() < {"a": 0.05, "b": 0.5, "c": 1.0}[k]]
    df = spark.createDataFrame(rows, "k string, p long")
    got = {(r.k, r.p) for r in backtest.non_overlapping(df, ["k"], "p", 7, size).collect()}
    want, free = set(), {}
    for k, p in sorted(rows):
        if p >= free.get(k, 0):
            want.add((k, p))
            free[k] = p + 7
    assert got == want


def test_trades_timeline_and_drawdown(klines):
    opens = [100, 110, 121, 100, 90, 81, 80]
    b = bars(klines, [("A", i, float(o), 1, {"high": o * 1.1, "low": o * 0.9}) for i, o in enumerate(opens)]).withColumn("s", F.when(F.col("pos") == 0, 1).when(F.col("pos").isin(1, 3), -1))
    t = backtest.trades(b, "s", 2, costs=COSTS).orderBy("pos").toPandas()
    assert t["pos"].tolist() == [0, 3] and t["gross"].tolist() == pytest.approx([100 / 110 - 1, -(80 / 90 - 1)])
    line = backtest.timeline(b, backtest.trades(b, "s", 2, costs=COSTS)).orderBy("pos").toPandas()
    assert line["ret"].tolist() == pytest.approx([0, 0.1 - 0.001, 100 / 121 - 1 - 0.001, 0, 0.1 - 0.001, 1 - 80 / 81 - 0.001, 0])
    for size in (3, 100):
        d = backtest.drawdown(backtest.timeline(b, backtest.trades(b, "s", 2, costs=COSTS)), ["symbol"], "pos", size).first()
        v = np.cumprod(1 + line["ret"].to_numpy())
        assert d.compounded == pytest.approx(v[-1] - 1) and d.max_drawdown == pytest.approx((v / np.maximum.accumulate(v) - 1).min())


def test_splits_and_frozen_models(spark):
    assert [f["test_to"] for f in splits.walk_forward(500, 100, 50, 50, 100, 5)] == [210, 310, 410]
    assert splits.purge_bars(24, 15) == 96
    with pytest.raises(ValueError):
        splits.walk_forward(10, 0, 1, 1, 1)
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "k string, p int, x double")
    fit = lambda d: study.fit_quantiles(splits.chronological(d, F.col("p"), F.lit(100)).where("part = 'train'"), ["k"], "x", 4).first().edges
    assert fit(df) == fit(df.withColumn("x", F.when(F.col("p") >= 60, 1e9).otherwise(F.col("x"))))
    assert study.fit_quantiles(df.where("p < 3"), ["k"], "x", 4).count() == 0


def test_statistics():
    v = np.random.default_rng(0).normal(1, 1, 400)
    lo, hi = study.bootstrap_mean(v, 20)
    assert lo < v.mean() < hi and study.bootstrap_mean(v, 20) == (lo, hi) and study.bootstrap_mean(v[:10], 20) is None
    assert study.clusters(["a", "b", "c"], np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])) == [0, 0, 1]
    assert study.deflated_sharpe(1.0, [1.0], 100) is None and 0 < study.deflated_sharpe(0.2, [0.1, 0.2, 0.15], 100) < 1


def test_guarded_statistics(spark):
    df = spark.createDataFrame([("a", float(i), 1.0, 2.0 * i) for i in range(30)], "k string, x double, y double, z double")
    c = {(r.a, r.b): r["corr"] for r in study.correlation_pairs(df, ["k"], ["x", "y", "z"]).collect()}
    assert c[("x", "y")] is None and c[("x", "z")] == pytest.approx(1.0)


def test_conflicts_are_errors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert quality.deduplicate(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="conflicting"):
        quality.deduplicate(df.union(spark.createDataFrame([(2, "c")], "k int, v string")), ["k"]).collect()
    with pytest.raises(ValueError, match="missing columns: z"):
        require_columns(df, {"z"})


def test_normalise(spark):
    df = spark.createDataFrame([(1.6e9,), (1.6e12,), (1.6e15,), (1.6e18,), (5.0,)], "v double")
    r = df.select(epoch_unit(F.col("v")).alias("u"), epoch_micros(F.col("v"), epoch_unit(F.col("v"))).alias("us")).collect()
    assert [x.u for x in r] == ["s", "ms", "us", "ns", None] and {x.us for x in r[:4]} == {1_600_000_000_000_000}
    rows = spark.createDataFrame([(["1", "8", "0.1"],), (["x", "8", "0.1"],)], "fields array<string>")
    assert [x.funding_rate for x in positional(rows, "fundingRate").collect()] == ["0.1"]
    sides = spark.createDataFrame([(True,), (False,), (None,)], "m boolean").select(aggressor_side(F.col("m")).alias("s")).collect()
    assert [x.s for x in sides] == [-1, 1, None]


def test_archives(spark, tmp_path):
    for name, members in (("a.zip", ["1,2\n3,4\n"]), ("b.zip", ["x", "y"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, text in enumerate(members):
                z.writestr(f"{k}.csv", text)
    (tmp_path / "c.zip").write_bytes(b"no zip")
    got = {(r.archive_object, r.status, r.line_no, r.line) for r in read_zip_lines(spark, str(tmp_path)).collect()}
    assert got == {("a.zip", "OK", 1, "1,2"), ("a.zip", "OK", 2, "3,4"), ("b.zip", "BAD_ARCHIVE", None, None), ("c.zip", "BAD_ARCHIVE", None, None)}
    sums = spark.createDataFrame([("a.zip", hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()), ("b.zip", "0")], "archive_object string, sha256 string")
    assert {(r.archive_object, r.status) for r in read_zip_lines(spark, str(tmp_path), sums).collect()} == {("a.zip", "OK"), ("b.zip", "CHECKSUM_MISMATCH"), ("c.zip", "CHECKSUM_MISMATCH")}
    assert ArchivePath("um", "klines", "AB", "2024-01", "1h").path("/r") == "/r/um/monthly/klines/AB/1h/AB-1h-2024-01.zip"
    with pytest.raises(ValueError):
        ArchivePath("um", "klines", "AB", "2024").path("/r")


def test_sinks(spark, tmp_path):
    s = synthetic_bars(spark, 1000).withColumns({"market": F.lit("um"), "symbol": F.lit("S"), "timeframe": F.lit("1h")})
    assert s.where("high < greatest(open, close) or low > least(open, close)").count() == 0 and s.select(F.sum("close")).first() == s.select(F.sum("close")).first()
    write_panel(s, str(tmp_path / "p"), "open_time", monthly=True)
    write_panel(s.where("month(open_time) = 1"), str(tmp_path / "p"), "open_time", monthly=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1000
    known = spark.createDataFrame([("u", "1")], "url string, sha string")
    new = spark.createDataFrame([("u", "1"), ("u", "2"), ("u", "2")], "url string, sha string")
    assert [r.sha for r in append_revisions(known, new, ["url", "sha"]).collect()] == ["2"]
    for k in (1, 2):
        append_record(str(tmp_path / "r.jsonl"), {"b": k, "a": 0})
    assert (tmp_path / "r.jsonl").read_text() == '{"a": 0, "b": 1}\n{"a": 0, "b": 2}\n'
    write_tables({"x": known}, str(tmp_path / "t"), ["x", "y"])
    assert [r.status for r in spark.read.option("header", True).csv(str(tmp_path / "t/y")).collect()] == ["INSUFFICIENT EVIDENCE"]
    with pytest.raises(ValueError):
        write_tables({"z": known}, str(tmp_path / "t"), ["x"])


def test_streams_give_what_batches_give(spark, tmp_path):
    zero = datetime(2024, 1, 1)
    rows = [("s", zero + timedelta(seconds=7 * i), 100.0 + i % 13, 1.0 + i % 3, '{"st": "1", "o": {"s": "AB"}}') for i in range(200)] + [("s", zero + timedelta(hours=5), 1.0, 1.0, "{}")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, price double, qty double, payload string")
    for n in range(3):
        df.where(f"ts < '2024-01-01 04:00:00' and pmod(second(ts), 3) = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("ts > '2024-01-01 04:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bars_from_trades(stream, ["k"], "ts", "price", "qty", delay="2 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r.open_time: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.open_time: r for r in bars_from_trades(df, ["k"], "ts", "price", "qty").collect()}
    assert len(got) >= 20 and all(got[t] == want[t] for t in got)
    log = append_log(routed(stream), str(tmp_path / "log"), str(tmp_path / "c2"))
    log.awaitTermination(120)
    assert {(r.market, r.symbol): r["count"] for r in spark.read.json(str(tmp_path / "log")).groupBy("market", "symbol").count().collect()} == {("um", "AB"): 200, ("unknown", "unknown"): 1}


def test_measured_broadcast(spark):
    small = written(spark.range(10).withColumn("x", F.lit("a")), "t")
    assert "broadcast" in spark.range(10).join(measured_broadcast(small), "id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert measured_broadcast(small, rows=5) is small


@pytest.mark.parametrize("shape", [(100, 50, 50, 100, 5), (10, 7, 9, 4, 2)])
def test_folds_cover_the_whole_length(spark, shape):
    lengths = [1, 27, 209, 210, 500, 850, 1500]
    n = spark.createDataFrame([(x,) for x in lengths], "n long")
    want = {}
    for x in lengths:
        for f in splits.walk_forward(x, *shape):
            want |= {(x, f["fold"], "train"): (0, f["train_to"]), (x, f["fold"], "validation"): (f["validation_from"], f["validation_to"]), (x, f["fold"], "test"): (f["test_from"], f["test_to"])}
    got = {(r["n"], r["fold"], r["part"]): (r["first"], r["end"]) for r in splits.fold_table(n, F.col("n"), *shape).collect()}
    assert got == want
    rows = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("p"))
    tagged = splits.in_folds(rows, F.col("p"), F.col("n"), *shape).groupBy("n", "fold", "part").agg(F.min("p").alias("a"), F.max("p").alias("z"), F.count("*").alias("c")).collect()
    assert {(r["n"], r["fold"], r["part"]): (r["a"], r["z"] + 1) for r in tagged} == want and all(r["c"] == r["z"] + 1 - r["a"] for r in tagged)
    assert splits.fold_table(n, F.col("n"), *shape).agg(F.max("end")).first()[0] > 1500 - shape[3] - 1


def test_rules_overlap(spark):
    from conftest import DATA

    from barloom.queries.research import mo_overlap_signals

    got = mo_overlap_signals(spark, str(DATA))
    assert got.select("a", "b").distinct().count() == 14 * 13 // 2


def test_family_has_its_median(spark, klines, tmp_path):
    from barloom.queries.research import ag_family

    rows = [("A", i, float(100.0 + 10 * np.sin(i / 9) + (i % 7)), 1, None) for i in range(300)]
    klines(rows).write.parquet(str(tmp_path / "klines.parquet"))
    got = ag_family(spark, str(tmp_path)).toPandas()
    assert {"ema", "rsi", "donchian", "roc"} == set(got["parameter_family"])
    for family, g in got.groupby("parameter_family"):
        assert 1 <= len(g) <= 3 and np.allclose(g["family_best"], g["net_return"].max(), atol=2e-6) and np.allclose(g["family_median"], g["net_return"].median(), atol=2e-6)
        assert np.allclose(g["family_positive"], (g["net_return"] > 0).mean())


def test_bar_returns_are_not_clipped(spark, klines, tmp_path):
    from barloom.queries.research import mo_boot

    klines([("A", i, 100.0, 1, {"open": 20.0, "high": 100.0, "low": 20.0} if i == 3 else None) for i in range(8)]).write.parquet(str(tmp_path / "klines.parquet"))
    assert mo_boot(spark, str(tmp_path)).first()["mean"] == pytest.approx(4 / 8)


def test_draws_of_the_bootstrap_are_never_broadcast(spark):
    rng, want, rows = np.random.default_rng(3), {}, []
    for key, n in (("a", 19), ("b", 20), ("c", 333), ("d", 4), ("é", 1000)):
        v = rng.normal(size=n)
        rows += [(key, 7, 3 * i, float(x)) for i, x in enumerate(v)] + [(key, 7, 3 * n, None)]
        size = max(2, int(n**0.5))
        u = np.array([[int(hashlib.md5(f"{key}|7|{s}|{k}".encode()).hexdigest()[:13], 16) / 2**52 for k in range(-(-n // size))] for s in range(200)])
        means = [np.concatenate([v[f:f + size] for f in np.floor(x * (n - size + 1)).astype(int)])[:n].mean() for x in u]
        want[key] = (n, v.mean(), *(np.quantile(means, [0.025, 0.975]) if n >= 20 else (None, None)))
    df = spark.createDataFrame(rows, "k string, h int, at long, v double")
    for limit in ({}, {"whole": 1}, {"whole": 500}):
        got = study.bootstrap_blocks(df, ["k", "h"], "v", "at", **limit)
        out = {r["k"]: (r["n"], r["mean"], r["lo"], r["hi"]) for r in got.collect()}
        assert out.keys() == want.keys()
        assert all(out[key] == pytest.approx(w) for key, w in want.items())
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not any("BroadcastHashJoin" in x and ("from_" in x or "to_" in x) for x in plan)


def test_study_of_one_series(spark, klines, tmp_path):
    from barloom.queries.research import mo_study

    close = np.round(100 + np.random.default_rng(5).normal(size=300).cumsum(), 1)
    klines([("A", i, float(c), 1, {"open": float(o), "high": float(max(o, c)), "low": float(min(o, c))}) for i, (o, c) in enumerate(zip([100.0, *close[:-1]], close))]).write.parquet(str(tmp_path / "klines.parquet"))
    df = mo_study(spark, str(tmp_path))
    got = {(r["horizon"], r["slice"]): r for r in df.collect()}
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("BroadcastHashJoin" in x and ("from_" in x or "to_" in x) for x in plan)
    o, at = pd.Series([100.0, *close[:-1]]), pd.Series(range(300))
    for h in (1, 4):
        v = pd.DataFrame({"x": close / o - 1, "y": pd.Series(close).shift(-h) / o.shift(-1) - 1})[(at >= 182) & (at + h < 240)]
        for name, s in (("overall", v), ("feature_positive", v[v["x"] > 0]), ("feature_negative", v[v["x"] < 0])):
            r = got[h, name]
            assert (r["n"], r["median_ret"], r["rank_ic"]) == pytest.approx((len(s), s["y"].median(), s["x"].rank().corr(s["y"].rank())), abs=2e-6)
        assert got[h, "overall"]["ci_low"] < v["y"].mean() < got[h, "overall"]["ci_high"]
