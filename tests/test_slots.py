"""Readings, regular grid, rolling totals and spikes on small cases."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.grid import regular_grid
from barloom.operators.rolling import rolling_totals
from barloom.operators.segments import segment_table, segmented
from barloom.operators.slots import readings
from barloom.operators.spikes import departures, flag_readings

ZERO = 1_704_067_200 // 60  # minutes until 2024


def audits(spark, first, last, timeframe="1m"):
    step = {"1m": 60, "1d": 86400}[timeframe]
    at = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n * step)
    return spark.createDataFrame([("um", "A", timeframe, at(first), at(last), "x")], "market string, symbol string, timeframe string, audited_from timestamp, audited_to timestamp, status string")


def test_the_last_delivery_of_a_slot_counts(spark, klines):
    k = klines([("A", 0, 1.0, 5, None), ("A", 0, 2.0, 9, None), ("A", 0, 2.0, 9, None), ("A", 1, 3.0, None, None), ("A", 1, 4.0, 1, None), ("A", None, 9.0, 1, None), (None, 2, 1.0, 1, None)])
    k = k.withColumn("open_time", F.expr("open_time + interval 20 seconds"))
    got = {(r.slot_no - ZERO): r.close for r in readings(k, ["close"]).collect()}
    assert got == {0: 2.0, 1: 4.0}


def test_a_halo_repeats_neighbours_only(spark, klines):
    k = klines([("A", i, float(i + 1), 1, None) for i in range(40)])
    r = readings(k, ["close"], halo=2, block=8)
    assert r.where("own").count() == 40 and r.where("own").select("slot_no").distinct().count() == 40
    inner = r.groupBy("block").agg(F.min("slot_no").alias("a"), F.max("slot_no").alias("b"), F.count("*").alias("n")).collect()
    assert max(x.n for x in inner) == 12


@pytest.mark.parametrize("block", [4, 2048])
def test_grid_marks_and_fills(spark, klines, block):
    k = klines([("A", 2, 10.0, 1, None), ("A", 3, None, 1, None), ("A", 5, 16.0, 1, None), ("A", 30, 1.0, 1, None), ("A", 99, 5.0, 1, None)])
    g = {r.slot_no - ZERO: r for r in regular_grid(k, audits(spark, 0, 31), fill="linear", max_gap=5, block=block).collect()}
    assert sorted(g) == list(range(32))
    assert [g[i].status for i in (0, 2, 3, 4, 5, 31)] == ["MISSING", "OBSERVED", "NULL_VALUE", "MISSING", "OBSERVED", "MISSING"]
    assert [g[i].filled for i in (0, 2, 3, 4, 5, 6, 31)] == [None, 10.0, 12.0, 14.0, 16.0, None, None]


def test_grid_of_empty_tables(spark, klines):
    none = klines([])
    assert {r.status for r in regular_grid(none, audits(spark, 0, 5)).collect()} == {"MISSING"}
    assert regular_grid(klines([("A", 1, 1.0, 1, None)]), audits(spark, 0, 5).where("false")).count() == 0
    assert regular_grid(none, audits(spark, 5, 0)).count() == 0


def test_rolling_totals_are_exact_after_large_values(spark):
    days = spark.createDataFrame([("A", d, v, "x") for d, v in enumerate([1e15, 0.1, None, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0, 0.2])], "e string, d int, v double, day_no_x string")
    r = rolling_totals(days, ["e"], "d", ["v"], (7, 30)).orderBy("d").collect()
    assert float(r[8].total_v_7) == 0.0 and float(r[9].total_v_7) == 0.2
    assert float(r[9].total_v_30) == pytest.approx(1e15 + 0.3)
    assert r[1].avg_v_7 == pytest.approx((1e15 + 0.1) / 2)
    assert rolling_totals(days.where("false"), ["e"], "d", ["v"]).count() == 0


@pytest.mark.parametrize("block", [32, 2048])
def test_flags(spark, klines, block):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        c = 100 + float(rng.normal(0, 0.5))
        rows.append(("A", i, c, 1, {"high": c + 1, "low": c - 1, "quote_volume": 1000 * float(np.exp(rng.normal(0, 0.2)))}))
    rows[50] = ("A", 50, 100.0, 1, {"high": 180.0, "low": 99.0, "quote_volume": 1000.0})
    rows[70] = ("A", 70, 100.0, 1, {"high": 99.0, "low": 99.5, "quote_volume": 1000.0})
    for i in range(28, 33):  # across a block border
        rows[i] = ("A", i, 100.0, 1, {"high": 101.0, "low": 99.0, "quote_volume": 777.0})
    for i in range(90, 94):  # one bar too short
        rows[i] = ("A", i, 100.0, 1, {"high": 101.0, "low": 99.0, "quote_volume": 778.0})
    rows[110] = ("A", 110, 100.0, 1, {"high": None, "low": None, "quote_volume": None})
    got = {(r.slot_no - ZERO, r.kind) for r in flag_readings(klines(rows + rows[:3]), block=block).collect()}
    assert got == {(50, "SPIKE"), (70, "IMPOSSIBLE")} | {(i, "STUCK") for i in range(28, 33)}


def test_departures_match_numpy_in_any_blocks(spark, klines):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(0, 1, 90))
    k = klines([("A", i, float(v), 1, None) for i, v in enumerate(x) if i % 7])
    want = {i: abs(np.log(x[i] / np.median([x[j] for j in range(max(0, i - 10), min(90, i + 11)) if j % 7]))) for i in range(90) if i % 7}
    for block in (16, 2048):
        got = {r.slot_no - ZERO: r.dep_high for r in departures(k, block=block).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


@pytest.mark.parametrize("block", [4, 2048])
def test_segments_across_blocks(spark, klines, block):
    at = [0, 1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 20, 30, 31]
    b = segmented(readings(klines([("A", i, 1.0, 1, None) for i in at]), ["close"], block=block), block=block)
    got = {r.slot_no - ZERO: (r.segment_id, r.pos) for r in b.collect()}
    assert got == {i: (s, i - f) for s, (f, xs) in enumerate([(0, at[:3]), (5, at[3:11]), (20, [20]), (30, [30, 31])]) for i in xs}
    t = {r.segment_id: (r.bars, r.gap_size_bars) for r in segment_table(b).collect()}
    assert t == {0: (3, 0), 1: (8, 2), 2: (1, 7), 3: (2, 9)}


def test_rolling_totals_have_no_bounds(spark):
    values = [1e-12, 0.0, 1e25, None, float("nan"), float("inf"), 2e25] + [0.0] * 8
    days = spark.createDataFrame([("e", k, v) for k, v in enumerate(values)], "e string, d long, v double")
    r = rolling_totals(days, ["e"], "d", ["v"], (2,)).orderBy("d").collect()
    total = [float(x.total_v_2) + x.rest_v_2 for x in r]
    assert total[0] == 1e-12 and abs(total[3] / 1e25 - 1) < 1e-12 and abs(total[6] / 2e25 - 1) < 1e-12 and total[8:] == [0.0] * 7


def test_fences_know_the_hour(spark, klines):
    from barloom.operators.spikes import fenced_readings

    rng = np.random.default_rng(5)
    # Ten days of hours: wide at noon, narrow otherwise. The same move is normal at noon only.
    rows = [("A", k, float(100 * np.exp(rng.normal(0, 0.2 if k % 24 == 12 else 0.001))), 1, None) for k in range(240)]
    rows[135] = ("A", 135, 140.0, 1, None)
    flags = {(r.slot_no - 473_352, r.kind) for r in fenced_readings(klines(rows, "1h"), least=8).collect()}
    hours = {k for k, kind in flags if kind == "SPIKE"}
    assert 135 in hours and (135, "JUMP") in flags and not any(k % 24 == 12 for k in hours)
    assert fenced_readings(klines(rows, "1h").where("false")).count() == 0
