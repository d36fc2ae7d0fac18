"""Timestamps of mixed formats, precisions and zones to UTC instants.

A text becomes a shape mask (every digit 9, every letter a, the rest as it is). A distinct mask is
looked up in the layouts once and its parser, a set of column slices, is kept; all texts of a mask are
then converted together on fixed-width arrays. Wall-clock times go through the zone transition tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import zones
from barloom.operators.slots import micros, step_us
from barloom.plans.materialize import measured_broadcast, written
from barloom.sources.tables import require_columns

_ADDED = ("open_ms", "close_ms", "open_status", "close_status", "tz_version")
INSTANT = "early_ms long, late_ms long, status string, release string"
_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "a" for r in (range(65, 91), range(97, 123)) for c in r}})
_BLANKS = " \t\r\n"

_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa)(?!a))?"
_ZONE = r"(?:(?P<z>a)| ?(?P<sg>[+-])(?P<zh>99)(?::?(?P<zm>99))?(?:\[(?P<zn>a[a/_+9-]*)\])?| (?P<zt>aaaa?))?"
_LAYOUTS = [re.compile(p) for p in (
    rf"(?P<Y>9999)(?P<s1>[-/.])(?P<m>99)(?P=s1)(?P<d>99)[a ]{_TIME}{_ZONE}",
    rf"(?P<Y>9999)(?P<m>99)(?P<d>99)a?(?P<H>99)(?P<M>99)(?P<S>99)(?P<f>9*){_ZONE}",
    rf"(?P<p1>99?)(?P<s1>[-/.])(?P<p2>99?)(?P=s1)(?P<Y>9999|99) {_TIME}{_ZONE}",
    rf"(?:aaa, )?(?P<d>99?) (?P<mn>aaa) (?P<Y>9999) {_TIME}{_ZONE}",
)]
_NUMBER = re.compile(r"(?P<neg>-?)(?P<i>9{1,19})(?:\.(?P<f>9+))?")
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


@dataclass(frozen=True)
class Semantics:
    """What a dataset's times mean, read from its description."""

    number: str = "magnitude"  # magnitude, ms, serial, or none
    zone: str | None = None  # of wall-clock times; None where a row must carry its own
    order: str = "year"
    compact: bool = False
    serial_epoch: int = 25569
    abbreviations: tuple = field(default=())
    known: bool = True


# Words that a description of times uses; one that has none of them is not understood.
_TOLD = re.compile(r"wall clock|epoch|zone as written|zone abbreviation|offset|serial day|1970-01-01|first")


@lru_cache(4096)
def read_semantics(text: str | None) -> Semantics:
    """The description's zone, field order, number unit and fixed zone abbreviations. A missing
    description means that rows carry their own zone; of one that is not understood only times with a zone of their
    own are read."""
    t = text or ""
    if t and not _TOLD.search(t):
        return Semantics("none", known=False)
    zone = re.search(r"wall clock ([A-Za-z_]+(?:/[A-Za-z_+-]+)*)", t)
    order = "day" if "day first" in t else "month" if "month first" in t else "year"
    number = "none" if zone and "zone as written" not in t else "magnitude"
    serial = re.search(r"day (\d+) is 1970-01-01", t)
    if serial:
        number = "serial"
    elif "epoch milliseconds" in t:
        number = "ms"
    abbr: dict[str, int] = {"utc": 0, "gmt": 0}
    if m := re.search(r"([A-Z]{2,5}(?:/[A-Z]{2,5})*) are fixed offsets ([+-]?\d+(?:/[+-]?\d+)*)", t):
        abbr |= {k.lower(): int(v) * 3600 for k, v in zip(m[1].split("/"), m[2].split("/"))}
    return Semantics(number, zone[1] if zone else None, order, "compact" in t, int(serial[1]) if serial else 25569, tuple(sorted(abbr.items())))


@lru_cache(65_536)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Kind of a mask and where its parts stand; None for a shape no layout has. Found once per mask."""
    if m := _NUMBER.fullmatch(mask):
        compact = re.fullmatch(r"9{14}|9{17}", mask)
        return ("compact" if compact else "number"), {k: m.span(k) for k, v in m.groupdict().items() if v}
    for layout in _LAYOUTS:
        if m := layout.fullmatch(mask):
            return "date", {k: m.span(k) for k, v in m.groupdict().items() if v}
    return None


def _digits(codes: np.ndarray, span: tuple[int, int] | None, default: int = 0) -> np.ndarray:
    if span is None:
        return np.full(len(codes), default, np.int64)
    out = np.zeros(len(codes), np.int64)
    for k in range(*span):
        out = out * 10 + (codes[:, k].astype(np.int64) - 48)
    return out


def _scaled(codes: np.ndarray, span: tuple[int, int] | None, digits: int) -> np.ndarray:
    """A fraction's first ``digits`` digits, as an integer of that many digits."""
    if span is None:
        return np.zeros(len(codes), np.int64)
    a, b = span
    n = min(b - a, digits)
    return _digits(codes, (a, a + n)) * 10 ** (digits - n)


def _words(texts: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    return np.array([t[span[0]:span[1]].lower() for t in texts])


def _looked_up(words: np.ndarray, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(words, return_inverse=True)
    return np.array([known.get(w, 0) for w in u], np.int64)[inv], np.array([w in known for w in u])[inv]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of proleptic Gregorian dates."""
    y = np.where(m <= 2, y - 1, y)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _convert(texts: np.ndarray, mask: str, sem: Semantics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of one mask under one description: early_ms, late_ms, number of instants (-1: unreadable)."""
    n = len(texts)
    bad = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64))
    # Long masks are rare and not kept.
    if (found := parser_of(mask) if len(mask) <= 80 else parser_of.__wrapped__(mask)) is None:
        return bad
    kind, at = found
    if kind == "compact":
        if sem.number in ("none",) or sem.compact:
            return _convert_date(texts, _spans_compact(mask), sem, bad)
        kind = "number"
    if kind == "number":
        return _convert_number(texts, at, sem, bad)
    return _convert_date(texts, at, sem, bad)


def _spans_compact(mask: str) -> dict[str, tuple[int, int]]:
    at = {"Y": (0, 4), "m": (4, 6), "d": (6, 8), "H": (8, 10), "M": (10, 12), "S": (12, 14)}
    return at | ({"f": (14, len(mask))} if len(mask) > 14 else {})


def _codes(texts: np.ndarray) -> np.ndarray:
    a = texts.astype(str)
    return a.view(np.uint32).reshape(len(a), -1)


def _convert_number(texts, at, sem, bad):
    if sem.number == "none":
        return bad
    codes, width = _codes(texts), at["i"][1] - at["i"][0]
    whole, sign, count = _digits(codes, at["i"]), -1 if "neg" in at else 1, np.ones(len(texts), np.int64)
    if width == 19:
        # Digits beyond a long make their own rows unreadable, no others.
        over = np.array([t[slice(*at["i"])] > "9223372036854775807" for t in texts])
        whole[over], count[over] = 0, -1
    if sem.number == "serial":
        if width > 7:
            return bad
        part = (_scaled(codes, at.get("f"), 11) * 864 + 500_000) // 1_000_000
        ms = sign * (whole * 86_400_000 + part) - sem.serial_epoch * 86_400_000
    elif sem.number == "ms":
        if width > 16:
            return bad
        ms = sign * whole
    else:
        unit = 1000 if width <= 11 else 1 if width <= 14 else -1000 if width <= 17 else -1_000_000
        if unit == 1000:
            ms = sign * (whole * 1000 + _scaled(codes, at.get("f"), 3))
        else:
            ms = sign * whole if unit == 1 else (sign * whole) // -unit
    return ms, ms, count


def _convert_date(texts, at, sem, bad):
    codes = _codes(texts)
    y, ok = _digits(codes, at["Y"]), np.ones(len(texts), bool)
    if at["Y"][1] - at["Y"][0] == 2:
        y = y + np.where(y < 70, 2000, 1900)
    if "p1" in at:
        if sem.order == "year":
            return bad
        d, m = (at["p1"], at["p2"]) if sem.order == "day" else (at["p2"], at["p1"])
        d, m = _digits(codes, d), _digits(codes, m)
    else:
        d = _digits(codes, at["d"])
        if "mn" in at:
            m, known = _looked_up(_words(texts, at["mn"]), _MONTHS)
            ok &= known
        else:
            m = _digits(codes, at["m"])
    ho, mi, se = _digits(codes, at.get("H")), _digits(codes, at.get("M")), _digits(codes, at.get("S"))
    if "ap" in at:
        pm, known = _looked_up(_words(texts, at["ap"]), {"am": 0, "pm": 1})
        ok &= known & (ho >= 1) & (ho <= 12)
        ho = ho % 12 + 12 * pm
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = np.where(m == 2, 28 + leap, np.where(np.isin(m, (4, 6, 9, 11)), 30, 31))
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= longest) & (ho < 24) & (mi < 60) & (se < 60)
    wall = _days(y, np.clip(m, 1, 12), d) * 86_400 + ho * 3600 + mi * 60 + se
    part = _scaled(codes, at.get("f"), 3)
    if "z" in at:
        ok &= _words(texts, at["z"]) == "z"
        early = late = wall
        count = np.ones(len(texts), np.int64)
    elif "sg" in at:
        zh, zm = _digits(codes, at["zh"]), _digits(codes, at.get("zm"))
        ok &= (zh <= 18) & (zm < 60)
        sign = np.where(codes[:, at["sg"][0]] == ord("-"), -1, 1)
        early = late = wall - sign * (zh * 3600 + zm * 60)
        count = np.ones(len(texts), np.int64)
    elif "zt" in at:
        shift, known = _looked_up(_words(texts, at["zt"]), dict(sem.abbreviations))
        ok &= known
        early = late = wall - shift
        count = np.ones(len(texts), np.int64)
    elif sem.zone is None:
        return bad
    else:
        early, late, count = zones.to_instants(wall, sem.zone)
    return early * 1000 + part, late * 1000 + part, np.where(ok, count, -1)


def convert(texts: pd.Series, semantics: pd.Series) -> pd.DataFrame:
    """early_ms, late_ms and status (OK, AMBIGUOUS, SKIPPED, UNREADABLE, UNKNOWN_SEMANTICS) of each text, and the release
    of the zone tables of the worker that read it."""
    n = len(texts)
    early, late, count, told = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    clean = [None if t is None else t.strip(_BLANKS) for t in texts.where(texts.notna(), None)]
    groups: dict[tuple, list[int]] = {}
    for i, (t, s) in enumerate(zip(clean, semantics.where(semantics.notna(), None))):
        if t:
            groups.setdefault((t.translate(_SHAPE), s), []).append(i)
    for (mask, s), rows in groups.items():
        r = np.array(rows)
        e, la, c = _convert(np.array([clean[i] for i in rows]), mask, read_semantics(s))
        early[r], late[r], count[r], told[r] = e, la, c, read_semantics(s).known
    status = np.select([count == 1, count == 2, count == 0, ~told], ["OK", "AMBIGUOUS", "SKIPPED", "UNKNOWN_SEMANTICS"], "UNREADABLE")
    gone = count < 1
    return pd.DataFrame({
        "early_ms": pd.Series(early, dtype="Int64").mask(gone), "late_ms": pd.Series(late, dtype="Int64").mask(gone), "status": status, "release": zones.version()})


def instants(texts: Column, semantics: Column) -> Column:
    """Column form of convert(): struct of INSTANT."""
    # Not to be copied into each expression that uses a part of it.
    return F.pandas_udf(convert, INSTANT).asNondeterministic()(texts, semantics)


def _nearest(inst: Column, target: Column) -> Column:
    e, la = inst["early_ms"], inst["late_ms"]
    return F.when(F.abs(la - target) < F.abs(e - target), la).otherwise(e)


def normalised_times(records: DataFrame, semantics: DataFrame) -> DataFrame:
    """``records`` with open_ms, close_ms (epoch milliseconds, null where a text denotes no instant),
    open_status, close_status and tz_version, the release of the zone tables.

    ``semantics`` (dataset, timestamp_semantics) is one row per dataset and is measured before it is
    broadcast. A text that is null, blank or of unknown shape, an impossible
    date and a wall-clock time that its zone skips denote nothing. Of a wall-clock time that occurs
    twice, the close is the latest candidate not behind received_at; without received_at the one that
    fits the open, else the earlier. The open is the candidate nearest to one timeframe before the
    close. Repeated rows stay repeated; an empty table stays empty; a dataset without a description is
    read as one whose rows carry their own zone. Columns of the added names are replaced.
    """
    require_columns(records, {"dataset", "timeframe", "open_time", "close_time", "received_at"})
    require_columns(semantics, {"dataset", "timestamp_semantics"})
    small = measured_broadcast(written(semantics.groupBy(F.col("dataset").alias("sem_dataset_")).agg(
        F.max("timestamp_semantics").alias("sem_")), "semantics"))
    # The record travels as one column, so its other columns' names cannot clash with those used here.
    kept = [F.col(x) for x in records.columns if x not in _ADDED]
    r = records.select(
        F.struct(*kept).alias("row_"), F.col("dataset").alias("ds_"), F.col("open_time").cast("string").alias("ot_"), F.col("close_time").cast("string").alias("ct_"),
        (step_us(F.col("timeframe")) / 1000).alias("step_"), (micros(F.col("received_at")) / 1000).alias("got_"))
    j = r.join(small, F.col("ds_") == F.col("sem_dataset_"), "left")
    j = j.withColumn("o_", instants(F.col("ot_"), F.col("sem_"))).withColumn("c_", instants(F.col("ct_"), F.col("sem_")))
    step, got, o, c = F.col("step_"), F.col("got_"), F.col("o_"), F.col("c_")
    twice = c["status"] == "AMBIGUOUS"
    close = (
        F.when(twice & got.isNotNull(), F.when(c["late_ms"] <= got, c["late_ms"]).otherwise(c["early_ms"]))
        .when(twice & (o["status"] == "OK"), _nearest(c, o["early_ms"] + step)).otherwise(c["early_ms"]))
    j = j.withColumn("close_ms_", close.cast("long"))
    open_ = F.when((o["status"] == "AMBIGUOUS") & F.col("close_ms_").isNotNull(), _nearest(o, F.col("close_ms_") - step)).otherwise(o["early_ms"])
    return j.select(
        "row_.*", open_.cast("long").alias("open_ms"), F.col("close_ms_").alias("close_ms"),
        o["status"].alias("open_status"), c["status"].alias("close_status"), o["release"].alias("tz_version"))
