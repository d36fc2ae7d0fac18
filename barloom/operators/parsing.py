"""Bar lines to typed bars, with what is wrong and where for lines that are not.

    record  = field { "," field } [ CR ] end
    field   = quoted | bare
    quoted  = '"' { any but '"' | '""' } '"'      directly before a comma or the end
    bare    = { any but ',' and '"' }

The grammar is parsed by recursive descent over running text. Where a broken quote may swallow the records
behind it, parsing resumes at the next validated record start (anchor): a start the source vouches for, as a
table with one line a row does, else a line that begins with a 13- or 16-digit epoch and a comma, or a header.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import require_columns

#: The columns of a bar line, in the order of the wire format.
KLINE_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "trade_count", "taker_buy_volume", "taker_buy_quote_volume", "ignore",
)
_PRICES, _VOLUMES = (1, 2, 3, 4), (5, 7, 9, 10)
PARSED = (
    "status string, reason string, field int, position int, open_us long, open double, high double, low double, close double, "
    "volume double, close_us long, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"
)
_NAMES = [x.split()[0] for x in PARSED.split(", ")]
_QUOTED = re.compile(r'"([^"]*+(?:""[^"]*+)*+)"')
_BARE = re.compile(r'[^,"]*')
_BARE_LINE = re.compile(r'[^,"\r\n]*')
_DECIMAL = re.compile(r"[ \t]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t]*")
_INTEGER = re.compile(r"[ \t]*([+-]?[0-9]+)[ \t]*")
_EPOCH = re.compile(r"[ \t]*\+?([0-9]{13}(?:[0-9]{3})?)[ \t]*")
_ANCHOR = re.compile(r'^﻿?"?(?:[ \t]*\+?[0-9]{13}(?:[0-9]{3})?[ \t]*"?,|open_time"?(?:,|$))', re.M)


class Broken(Exception):
    """A syntax error at a position of the text, in a field counted from 1."""

    def __init__(self, at: int, field: int):
        super().__init__(at, field)
        self.at, self.field = at, field


def _field(s: str, i: int, end: int, number: int, stop: re.Pattern) -> tuple[str, int]:
    if i < end and s[i] == '"':
        m = _QUOTED.match(s, i, end)
        if m is None:
            raise Broken(i, number)
        j = m.end()
        if j < end and s[j] != "," and not (stop is _BARE_LINE and s[j] in "\r\n"):
            raise Broken(j, number)
        return m[1].replace('""', '"'), j
    m = stop.match(s, i, end)
    j = m.end()
    if j < end and s[j] == '"':
        raise Broken(j, number)
    return m[0], j


def _record(s: str, i: int, end: int, stop: re.Pattern = _BARE) -> tuple[list[str], list[int], int]:
    """Fields of the record at i, where each starts, and where the record ends."""
    values, starts = [], []
    while True:
        starts.append(i)
        v, i = _field(s, i, end, len(values) + 1, stop)
        values.append(v)
        if i < end and s[i] == ",":
            i += 1
        else:
            return values, starts, i


def _micros(text: str) -> int | None:
    m = _EPOCH.fullmatch(text)
    return None if m is None else int(m[1]) * (1000 if len(m[1]) == 13 else 1)


def _judge(values: list[str], starts: list[int]) -> tuple:
    """A status row for the fields of a record."""
    if values[0].removeprefix("﻿").strip('"') == "open_time":
        return ("HEADER",) + (None,) * 14
    fail = lambda why, k: ("FAIL", why, k + 1, starts[min(k, len(starts) - 1)] + 1) + (None,) * 11
    if len(values) != 12:
        return fail("COLUMN_COUNT", min(len(values), 12) - 1)
    out: list = [None] * 11
    for k in range(11):
        if k in (0, 6):
            v = _micros(values[k])
            if v is None or k == 6 and v <= out[0]:
                return fail("INVALID_VALUE", k)
        elif k == 8:
            m = _INTEGER.fullmatch(values[k])
            v = int(m[1]) if m and len(m[1]) < 20 else -1
            if not 0 <= v < 2**63:
                return fail("INVALID_VALUE", k)
        else:
            m = _DECIMAL.fullmatch(values[k])
            v = float(m[1]) if m else math.nan
            if not (v > 0 if k in _PRICES else v >= 0) or v == math.inf:
                return fail("INVALID_VALUE", k)
        out[k] = v
    return ("BAR", None, None, None, *out)


def _row_at(text: str, i: int, end: int, stop: re.Pattern = _BARE) -> tuple[tuple, int | None]:
    """Status row of the record at i and where it ends; None where a broken quote leaves the end unknown."""
    try:
        values, starts, j = _record(text, i, end, stop)
    except Broken as e:
        return ("FAIL", "BROKEN_QUOTING", e.field, e.at - i + 1) + (None,) * 11, None
    return _judge(values, [x - i for x in starts]), j


def parse_text(text: str, anchors: Sequence[int] | None = None) -> Iterator[tuple[int, tuple]]:
    """(line number from 1, status row) of every record of a text of many lines. Quoted fields may span
    lines. After a broken quote the text up to the next anchor belongs to the failed record.

    ``anchors`` are record starts that are known, as of a table that has one record a row: then no record reaches
    beyond the next of them, each is parsed to its end and gets the anchor's number. Without them an anchor is
    a line that begins as a record does.
    """
    n = len(text)
    if anchors is not None:
        for k, i in enumerate(anchors):
            end = anchors[k + 1] - 1 if k + 1 < len(anchors) else n
            end -= end > i and text[end - 1] == "\r"
            i += text[i:i + 1] == "\ufeff" and text.startswith('"open_time"', i + 1)
            yield k + 1, _row_at(text, i, end)[0]
        return
    i, line = 0, 1
    while i < n:
        row, j = _row_at(text, i + (text[i] == "\ufeff"), n, _BARE_LINE)
        if j is None:
            eol = text.find("\n", i)
            m = _ANCHOR.search(text, eol + 1) if eol >= 0 else None
            j = m.start() - 1 if m else n
        yield line, row
        if text[j:j + 1] == "\r":
            j += 1
        line += text.count("\n", i, j + 1)
        i = j + 1


def parse_line(line: str | None) -> tuple:
    """Status row (see PARSED) of one line. A null line has no field at all: COLUMN_COUNT."""
    if line is None:
        return ("FAIL", "COLUMN_COUNT", 1, 1) + (None,) * 11
    return next(parse_text(line, [0]))[1]


def parse_lines(lines: pd.Series) -> pd.DataFrame:
    """Status rows of lines, which are parsed as one running text with a known record start at each line's head."""
    texts = lines.fillna("").tolist()
    anchors, at = [], 0
    for t in texts:
        anchors.append(at)
        at += len(t) + 1
    rows = [r for _, r in parse_text("\n".join(texts), anchors)] if texts else []
    nothing = parse_line(None)
    out = pd.DataFrame([nothing if gone else r for r, gone in zip(rows, lines.isna())], columns=_NAMES)
    for c in ("field", "position", "open_us", "close_us", "trade_count"):
        out[c] = out[c].astype("Int64")
    return out


def parse_bars(lines: DataFrame, column: str = "raw_line") -> DataFrame:
    """``lines`` with one more column, ``parsed`` (see PARSED): status BAR with typed values, HEADER, or
    FAIL with the first reason that holds (BROKEN_QUOTING, COLUMN_COUNT, INVALID_VALUE), the field
    and the character where it was found. Every line gets exactly one row; an empty table stays empty."""
    require_columns(lines, {column})
    # Nondeterministic, lest the optimiser copies the parse into each expression that uses a part of it.
    return lines.withColumn("parsed", F.pandas_udf(parse_lines, PARSED).asNondeterministic()(F.col(column)))


def loaded_bars(parsed: DataFrame) -> DataFrame:
    """The valid lines with their typed columns in place of ``parsed``."""
    at = lambda c: F.timestamp_micros(F.col(f"parsed.{c}"))
    typed = [at("open_us").alias("open_time"), at("close_us").alias("close_time")]
    typed += [F.col(f"parsed.{c}").alias(c) for c in KLINE_COLUMNS[1:11] if c != "close_time"]
    taken = {"open_time", *KLINE_COLUMNS[1:11], "parsed"}
    return parsed.where(F.col("parsed.status") == "BAR").select(*[F.col(c) for c in parsed.columns if c not in taken], *typed)


def failed_lines(parsed: DataFrame) -> DataFrame:
    """The lines that fail, with reason, field and position."""
    return parsed.where(F.col("parsed.status") == "FAIL").select(
        *[F.col(c) for c in parsed.columns if c not in ("parsed", "reason", "field", "position")],
        *[F.col(f"parsed.{c}").alias(c) for c in ("reason", "field", "position")])


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of bar lines as archive_object, line_no and ``parsed``. A file is parsed by one task, since a
    quoted field may span lines; archives are one month of one series each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("archive_object"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["archive_object"], b["value"]):
                rows = [(name, k, dict(zip(_NAMES, r))) for k, r in parse_text(text)]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive_object", "line_no", "parsed"])

    return files.mapInPandas(run, f"archive_object string, line_no long, parsed struct<{PARSED.replace(' ', ':').replace(',:', ',')}>")
