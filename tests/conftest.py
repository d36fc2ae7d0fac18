from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import get_session

    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture
def klines(spark):
    """A maker of klines rows: (symbol, minute slot, close, ingested second, further columns)."""
    from datetime import datetime, timedelta

    columns = (
        "market string, symbol string, timeframe string, open_time timestamp, open double, high double, low double, close double, volume double, "
        "quote_volume double, trade_count long, taker_buy_volume double, ingested_at timestamp, block string, own string")

    def make(rows, timeframe="1m"):
        step = {"1m": 60, "1h": 3600, "1d": 86400, "15m": 900}[timeframe]
        zero, out = datetime(2024, 1, 1), []
        for symbol, slot, close, ingested, more in rows:
            r = {
                "market": "um", "symbol": symbol, "timeframe": timeframe, "open_time": None if slot is None else zero + timedelta(seconds=slot * step),
                "open": close, "high": close, "low": close, "close": close, "volume": 1.0, "quote_volume": close, "trade_count": 1, "taker_buy_volume": 0.5,
                "ingested_at": None if ingested is None else zero + timedelta(seconds=ingested), "block": "clash", "own": "clash"} | (more or {})
            out.append(tuple(r.values()))
        return spark.createDataFrame(out, columns)

    return make
