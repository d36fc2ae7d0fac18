"""Transports, archives, settings, ranks by ranges and the costs of trades on small cases."""

from __future__ import annotations

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.config import cost_model, load_config, outer_positions
from barloom.operators import backtest, joins, study
from barloom.operators.ranks import quantiles, running, with_rank
from barloom.sources.archives import ArchivePath, read_bars, read_funding
from barloom.sources.sinks import read_records, write_processed, write_report
from barloom.sources.transport import Failed, download, get_json, list_objects, list_prefixes, retrying

PAGE = """<ListBucketResult xmlns="x"><IsTruncated>{more}</IsTruncated>{token}{body}</ListBucketResult>"""


def page(keys, token=None, prefixes=()):
    body = "".join(f"<Contents><Key>{k}</Key><Size>{n}</Size></Contents>" for k, n in keys) + "".join(f"<CommonPrefixes><Prefix>{p}</Prefix></CommonPrefixes>" for p in prefixes)
    return PAGE.format(more=str(bool(token)).lower(), token=f"<NextContinuationToken>{token}</NextContinuationToken>" if token else "", body=body).encode()


def test_listings():
    pages = {None: page([("b", 1), ("a", 2)], "t", ["p/"]), "t": page([("b", 1), ("c", 3)])}
    assert [(o.key, o.size) for o in list_objects(lambda p, t: pages[t], "")] == [("a", 2), ("b", 1), ("c", 3)]
    assert list_prefixes(lambda p, t: pages[t], "") == ["p/"]
    with pytest.raises(ValueError, match="different contents"):
        list_objects(lambda p, t: {None: page([("b", 1)], "t"), "t": page([("b", 2)])}[t], "")
    with pytest.raises(ValueError, match="repeats"):
        list_objects(lambda p, t: page([("b", 1)], "t"), "")
    with pytest.raises(ValueError, match="without a token"):
        list_objects(lambda p, t: PAGE.format(more="true", token="", body="").encode(), "")


def test_retries_wait_and_end():
    waits, answers = [], [Failed(429, 5), OSError(), Failed(503), b'{"a": 1}']

    def send(path, headers):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        assert (path, headers) == ("/p?a=1&b=2", {"X-API-KEY": "k"})
        return x

    assert get_json(retrying(send, sleep=waits.append), "/p", {"b": 2, "a": 1}, "k") == {"a": 1} and waits == [5, 2, 4]
    with pytest.raises(Failed):
        retrying(lambda: (_ for _ in ()).throw(Failed(404)), sleep=waits.append)()
    assert len(waits) == 3


def test_downloads_never_change(tmp_path):
    store = {"u": b"abc", "u.CHECKSUM": f"{hashlib.sha256(b'abc').hexdigest()}  u\n".encode()}
    to = str(tmp_path / "x" / "u.zip")
    assert download(store.__getitem__, "u", to)["bytes"] == 3 and download(store.__getitem__, "u", to)["bytes"] == 3
    store |= {"u": b"abd"}
    with pytest.raises(ValueError, match="checksum"):
        download(store.__getitem__, "u", to)
    store["u.CHECKSUM"] = hashlib.sha256(b"abd").hexdigest().encode()
    with pytest.raises(ValueError, match="another archive"):
        download(store.__getitem__, "u", to)
    assert json.loads((tmp_path / "x" / "u.zip.manifest.json").read_text())["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_archive_dates():
    assert ArchivePath("um", "klines", "S", "2024-02", "1h").path("r").endswith("S-1h-2024-02.zip")
    for bad in ("2024-13", "2024-02-30"):
        with pytest.raises(ValueError):
            ArchivePath("um", "klines", "S", bad, "1h").path("r")


def zipped(path, name, text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, text)
    path.write_bytes(b.getvalue())


def test_bars_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("open_time,close,quote_volume\n1710576000000,1.123456785,2.1234565\n1710579600000,,3\n")
    got = read_bars(spark, str(tmp_path / "a.csv")).orderBy("open_time").collect()
    assert [r.close for r in got] == [1.12345678, None] and got[0].quote_volume == 2.123456 and str(got[0].open_time) == "2024-03-16 08:00:00"
    (tmp_path / "b.csv").write_text("open_time,close\n2024-03-16T08:00:00Z,1\n")
    assert read_bars(spark, str(tmp_path / "b.csv")).first().open_time == got[0].open_time
    line = "1710576000000,368.1,372.2,366.3,371.4,4566.5,1710590399999,1694417.6,13699,2054.7,762487.8,0"
    zipped(tmp_path / "S-1h-2024-03.zip", "S.csv", f"{line}\nbroken\n")
    bars = read_bars(spark, str(tmp_path / "S-1h-2024-03.zip"))
    assert [r.open for r in bars.collect()] == [368.1]
    write_processed(bars, str(tmp_path / "p.parquet"))
    assert read_bars(spark, str(tmp_path / "p.parquet")).count() == 1
    with pytest.raises(ValueError):
        read_bars(spark, "x.txt")


def test_funding_archives(spark, tmp_path):
    zipped(tmp_path / "AB-2024-01.zip", "x.csv", "calc_time,funding_interval_hours,last_funding_rate\n1000,8,0.1\n1000,8,0.1\nx,8,0.3\n")
    zipped(tmp_path / "AB-2024-02.zip", "x.csv", "timestamp,funding_rate\n2000,\n")
    (tmp_path / "AB-2024-03.zip").write_bytes(b"no zip")
    got = read_funding(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.symbol, r.funding_rate) for r in got] == [("AB", 0.1), ("AB", None)]


def test_settings_reports_and_registries(spark, tmp_path):
    (tmp_path / "c.toml").write_text("[research]\n[split]\n[rule]\n[costs]\nmaker_fee_bps = 1\ntaker_fee_bps = 4\nspread_bps = 2\nslippage_bps = 1\nlatency_bars = 1\n")
    c = cost_model(load_config(str(tmp_path / "c.toml")))
    assert c == backtest.Costs(1, 4, 2, 1, 1) and c.round_trip("maker") == 6 / 10_000 and outer_positions(100, 0.6, 0.2, 5) == (60, 65, 80, 85)
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert read_records(spark, str(tmp_path / "r.jsonl")).count() == 2
    write_report(str(tmp_path / "r.md"), "T", {"b": 1}, [{"x": 1}])
    assert "| x |" in (tmp_path / "r.md").read_text()


def test_ranks_and_quantiles_by_ranges(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(40))) for g in "aab" for _ in range(200)] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in running(df, ["g"], "v").collect():
        assert r.below == sum(x < r.v for g, x in rows if g == r.g and x is not None)
    import numpy as np

    for r in quantiles(df, ["g"], "v", [0.5, 0.05, 1.0], "q").collect():
        assert np.allclose(r.q, np.quantile([x for g, x in rows if g == r.g and x is not None], [0.5, 0.05, 1.0]))
    ranked = with_rank(df, ["g"], "v", "r").where("v is not null and g is not null").toPandas()
    assert np.allclose(ranked.groupby("g")["v"].rank(), ranked["r"])
    assert quantiles(df.where("false"), ["g"], "v", [0.5], "q").count() == 0


def test_spread_and_funding_of_trades(spark):
    opens = [100.0, 101.0, 103.0, 102.0, 104.0, 105.0, 107.0, 106.0]
    rows = [("um", "S", "1h", 0, k, k, o, o + 1, o - 1, o + 0.5, 1 if k == 1 else 0, [None, 4.0][k % 2], 0.001) for k, o in enumerate(opens)]
    df = spark.createDataFrame(rows, "market string, symbol string, timeframe string, segment_id long, slot_no long, pos long, open double, high double, low double, close double, s int, sp double, f double")
    t = backtest.trades(df, "s", 2, backtest.Costs(spread_bps=2), spread="sp", funding="f").first()
    # Entered at bar 2, where the spread is the assumed one, left at bar 4: two bars' funding.
    assert (t.pos, t.entry, t.exit) == (1, 103.0, 104.0) and abs(t.funding - 0.002) < 1e-12 and abs(t.spread - 2e-4) < 1e-12
    assert abs(t.net - (104 / 103 - 1 - 0.001 - 2e-4 - 2e-4 - 0.002)) < 1e-12 and (t.bars_to_mfe, t.bars_to_mae) == (1, 2)
    line = backtest.timeline(df, backtest.trades(df, "s", 2, spread="sp", funding="f"), funding="f").orderBy("pos").toPandas()["ret"]
    assert line[[0, 1, 4, 5]].abs().max() == 0 and abs(line[2] - (102 / 103 - 1 - 0.001 - t.entry_cost)) < 1e-12
    gap = df.withColumn("f", F.when(F.col("pos") != 3, F.col("f")))
    with pytest.raises(Exception, match="without funding"):
        backtest.trades(gap, "s", 2, funding="f").collect()
    assert backtest.trades(gap, "s", 2, funding="f", long_only=F.lit(True)).first().funding == 0.0
    with pytest.raises(ValueError):
        backtest.trades(df, "s", 2, fee_mode="free")


def test_keys_without_trades_are_reported(spark):
    rows = [("um", "S", "1h", 0, k, k, 100.0, 100.0, 100.0, 100.0, 0) for k in range(8)]
    df = spark.createDataFrame(rows, "market string, symbol string, timeframe string, segment_id long, slot_no long, pos long, open double, high double, low double, close double, s int")
    t = backtest.trades(df, "s", 2)
    s = backtest.summary(t, ["symbol"], df.groupBy("symbol").agg(F.count("*").alias("bars"))).first()
    assert (s.trade_count, s.exposure, s.evidence_status, s.net_return) == (0, 0.0, "INSUFFICIENT EVIDENCE", None)


def test_regimes_are_unavailable_without_inputs(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("a", None, 1.0, 1.0), ("a", 9.0, 3.0, -1.0)], "k string, realized_vol20 double, quote_volume double, btc_regime double")
    th = spark.createDataFrame([("a", [1.0, 2.0, 3.0], [1.0, 4.0])], "k string, vol_edges array<double>, qv_edges array<double>")
    got = {tuple(r[c] for c in study.REGIMES) for r in study.regimes(df, th, ["k"]).collect()}
    none = ("unavailable",) * 3
    assert got == {("unavailable", "low", "high", *none), ("bull", "unavailable", "low", *none), ("bear", "panic_extreme", "medium", *none)}


def test_month_context(spark):
    m = spark.createDataFrame([("s", "2024-01"), ("s", "2024-02")], "symbol string, universe_month string")
    o = spark.createDataFrame([("s", x, "c") for x in ("2023-10", "2023-11", "2023-12", "2024-01", "2024-03")], "symbol string, am string, row_class string").drop("row_class")
    got = {r.am: r.row_class for r in joins.month_context(m, o, ["symbol"], "universe_month", "am").collect()}
    assert got == {"2023-11": "WARMUP_CONTEXT_ONLY", "2023-12": "WARMUP_CONTEXT_ONLY", "2024-01": "RESEARCH_ELIGIBLE"}
