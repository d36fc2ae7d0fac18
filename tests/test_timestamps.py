"""Formats, zones, gaps and folds of timestamps against the standard library."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from barloom.functions.zones import to_instants
from barloom.operators.timestamps import convert, normalised_times, parser_of

UTC = timezone.utc
BERLIN = "wall clock Europe/Berlin, day first, no zone written"
HUDSON = "wall clock America/New_York, month first, no zone written"
GANGA = "wall clock Asia/Kolkata, year first, compact digits, no zone written"
SHEET = "serial day number, day 25569 is 1970-01-01, UTC; rounded to whole milliseconds"
EPOCH = "integer or decimal epoch; unit (s, ms, us, ns) differs from row to row"
ABBR = "zone abbreviation behind the time; EST/EDT/CET/CEST/JST are fixed offsets -5/-4/+1/+2/+9"
MIXED = "zone as written; rows without one are wall clock Europe/Berlin, year first"


def ms(*a, zone=UTC, milli=0):
    return int(datetime(*a, tzinfo=zone).timestamp()) * 1000 + milli


@pytest.mark.parametrize(
    ("text", "semantics", "want"),
    [
        ("09.03.19 21:00:00", BERLIN, ms(2019, 3, 9, 20)), ("05.12.2019 13:30:13,298", BERLIN, ms(2019, 12, 5, 12, 30, 13, milli=298)), ("10.07.2019 00:59", BERLIN, ms(2019, 7, 9, 22, 59)),
        ("5/15/2020 12:00:00 pm", HUDSON, ms(2020, 5, 15, 16)), ("05/15/2020 12:05:00 AM", HUDSON, ms(2020, 5, 15, 4, 5)), ("20190714T013034", GANGA, ms(2019, 7, 13, 20, 0, 34)),
        ("20190714003034650", GANGA, ms(2019, 7, 13, 19, 0, 34, milli=650)), ("44271.5", SHEET, ms(2021, 3, 16, 12)), ("44271.187885104", SHEET, 1615869033273),
        ("1646469927", EPOCH, 1646469927000), ("1646469927035", EPOCH, 1646469927035), ("1646469927035999", EPOCH, 1646469927035), ("1646469927035999999", EPOCH, 1646469927035), ("1486929599.9999", EPOCH, 1486929599999),
        ("1446505200000", "epoch milliseconds, UTC", 1446505200000), ("11 Nov 2016 17:00:00 CET", ABBR, ms(2016, 11, 11, 16)), ("2020-07-28 13:59:59 EDT", ABBR, ms(2020, 7, 28, 17, 59, 59)),
        ("28 Jul 2020 19:00:00 CEST", ABBR, ms(2020, 7, 28, 17)), ("20 Jan 2020 00:00:00 UTC", ABBR, ms(2020, 1, 20)), ("Sat, 03 Dec 2022 23:45:00 GMT", "mail-style date, GMT or numeric offset", ms(2022, 12, 3, 23, 45)),
        ("Wed, 16 May 2018 03:00:08 -0330", "mail-style date, GMT or numeric offset", ms(2018, 5, 16, 6, 30, 8)), ("2023-06-07 21:30:00.000+0530", None, ms(2023, 6, 7, 16)), ("2024-10-15 20:45:00.000+02", None, ms(2024, 10, 15, 18, 45)),
        ("2023-04-30 07:59:59.999000000z", None, ms(2023, 4, 30, 7, 59, 59, milli=999)), ("2021-06-29T14:00:00-05:00[America/Chicago]", "offset and zone name written", ms(2021, 6, 29, 19)),
        ("2016/03/26 03:44:59.999", MIXED, ms(2016, 3, 26, 2, 44, 59, milli=999)), ("1454184000000", MIXED, 1454184000000), (" \t2023-06-07 21:30:00Z ", None, ms(2023, 6, 7, 21, 30)),
        ("2023-02-30T01:15:00", MIXED, None), ("2022-13-05 10:00:00", MIXED, None), ("0000-00-00 00:00:00", MIXED, None), ("", MIXED, None), (None, MIXED, None), ("yesterday", MIXED, None),
        ("2023-06-07 21:30:00", None, None), ("2016-03-27 02:30:00", MIXED, None), ("25:00", BERLIN, None), ("2020-07-28 13:59:59 XYZ", ABBR, None), ("9" * 500, EPOCH, None), ("2020-07-28 24:00:00Z", None, None),
    ])
def test_one_text(text, semantics, want):
    r = convert(pd.Series([text], dtype=object), pd.Series([semantics], dtype=object)).iloc[0]
    assert (None if pd.isna(r.early_ms) else int(r.early_ms)) == want


def test_numbers_beyond_a_long_take_no_others_along():
    texts = ["1646469927035999999", "9999999999999999999", "9223372036854775807", "9223372036854775808", "-1646469927035000000", "-9999999999999999999"]
    got = convert(pd.Series(texts, dtype=object), pd.Series([EPOCH] * len(texts), dtype=object)).early_ms
    assert [None if pd.isna(x) else int(x) for x in got] == [1646469927035, None, 9223372036854, None, -1646469927035, None]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "Europe/London", "UTC"])
def test_zones_against_the_standard_library(zone):
    z = ZoneInfo(zone)
    wall = [datetime(2016, 1, 1) + timedelta(minutes=30 * i) for i in range(0, 17520, 5)]
    early, late, n = to_instants(np.array([int(w.replace(tzinfo=UTC).timestamp()) for w in wall]), zone)
    for w, e, la, k in zip(wall, early, late, n):
        back = {int(w.replace(tzinfo=z, fold=f).timestamp()) for f in (0, 1)}
        real = {s for s in back if datetime.fromtimestamp(s, z).replace(tzinfo=None) == w}
        assert k == len(real) and (not real or (e, la) == (min(real), max(real)))


def test_unknown_zone_and_mask_cache():
    assert to_instants(np.array([0]), "Mars/Olympus")[2][0] == 0
    parser_of.cache_clear()
    convert(pd.Series(["2020-01-01 00:00:00Z"] * 1000), pd.Series([None] * 1000, dtype=object))
    assert parser_of.cache_info().misses == 1


def test_times_that_occur_twice(spark):
    got = lambda *a: datetime(*a)
    rows = [
        (1, "b", "15m", "2016-10-30 02:30:00", "2016-10-30 02:44:59.999", got(2016, 10, 30, 0, 46), "x"), (2, "b", "15m", "2016-10-30 02:30:00", "2016-10-30 02:44:59.999", got(2016, 10, 30, 1, 46), "x"),
        (3, "b", "1h", "2016-10-30 02:00:00", "2016-10-30 02:59", got(2016, 10, 30, 2, 4), "x"), (4, "b", "15m", "2016-10-30 02:45:00", "2016-10-30 02:59:59", None, "x"),
        (5, "none", "15m", "2016-10-30 02:45:00Z", "2016-10-30 02:59:59Z", None, "x"), (6, None, "15m", None, "", None, None), (1, "b", "15m", "2016-10-30 02:30:00", "2016-10-30 02:44:59.999", got(2016, 10, 30, 0, 46), "x")]
    v = spark.createDataFrame(rows, "rec_id long, dataset string, timeframe string, open_time string, close_time string, received_at timestamp, sem_ string")
    s = spark.createDataFrame([("b", MIXED)], "dataset string, timestamp_semantics string")
    r = {x.rec_id: (x.open_ms, x.close_ms) for x in normalised_times(v.drop("sem_"), s).collect()}
    assert r[1] == (ms(2016, 10, 30, 0, 30), ms(2016, 10, 30, 0, 44, 59, milli=999))
    assert r[2] == (ms(2016, 10, 30, 1, 30), ms(2016, 10, 30, 1, 44, 59, milli=999))
    assert r[3] == (ms(2016, 10, 30, 1), ms(2016, 10, 30, 1, 59))
    assert r[4] == (ms(2016, 10, 30, 0, 45), ms(2016, 10, 30, 0, 59, 59))
    assert r[5] == (ms(2016, 10, 30, 2, 45), ms(2016, 10, 30, 2, 59, 59)) and r[6] == (None, None)
    assert normalised_times(v.drop("sem_"), s).count() == 7 and normalised_times(v.where("false"), s).count() == 0


def test_years_beyond_any_table():
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    wall = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds())
    w = np.array([wall(2020, 7, 1, 12), wall(2600, 7, 1, 12), wall(9000, 1, 15, 3), wall(1850, 5, 5, 5), wall(1700, 5, 5, 5), wall(2150, 12, 31, 23)])
    early, late, count = to_instants(w, "Europe/Berlin")
    assert count.tolist() == [1] * 6 and (early == late).all()
    for s, e in zip(w.tolist(), early.tolist()):
        at = datetime(1970, 1, 1) + timedelta(seconds=s)
        assert s - e == at.replace(tzinfo=ZoneInfo("Europe/Berlin")).utcoffset().total_seconds(), at
    # The last Sunday of March 2600: an hour is skipped, as in any year.
    day = next(d for d in range(31, 24, -1) if datetime(2600, 3, d).weekday() == 6)
    assert to_instants(np.array([wall(2600, 3, day, 2, 30)]), "Europe/Berlin")[2].tolist() == [0]


def test_descriptions_not_understood_and_long_texts():
    texts = pd.Series(["2024-03-01 10:00:00", "2024-03-01T10:00:00Z", "1709287200000", "2024-03-01 10:00:00." + "0" * 200])
    assert convert(texts, pd.Series(["as the desk likes it"] * 4))["status"].tolist() == ["UNKNOWN_SEMANTICS", "OK", "UNKNOWN_SEMANTICS", "UNKNOWN_SEMANTICS"]
    got = convert(texts, pd.Series(["wall clock UTC, year first, no zone written"] * 4))
    assert got["status"].tolist() == ["OK", "OK", "UNREADABLE", "OK"] and got["early_ms"][3] == got["early_ms"][0] and (got["release"].str.len() > 0).all()
