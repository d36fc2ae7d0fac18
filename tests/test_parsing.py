"""The line grammar, its reasons in their order, and recovery behind a broken quote."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.operators.parsing import failed_lines, loaded_bars, parse_bars, parse_line, parse_text, read_bar_files

GOOD = "1710576000000,368.1,372.2,366.3,371.4,4566.5,1710590399999,1694417.6,13699,2054.7,762487.8,0"
F = GOOD.split(",")


def line(**at: str) -> str:
    f = list(F)
    for k, v in at.items():
        f[int(k[1:])] = v
    return ",".join(f)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, "BAR"), (GOOD + "\r", "BAR"), (",".join(f'"{x}"' for x in F), "BAR"), (line(_1=" +368.1 ", _5="3.6e+03"), "BAR"), (line(_11=""), "BAR"),
        (line(_11='"say ""no"""'), "BAR"), (line(_11='"a,b"'), "BAR"), (line(_0="1710576000000000", _6="1710590399999999"), "BAR"), (line(_5="0", _7="0"), "BAR"),
        ("open_time,open\r", "HEADER"), ('﻿"open_time","open"', "HEADER"), ("﻿open_time,open", "HEADER"), ("open_time", "HEADER"),
        (line(_3='"366.3'), "BROKEN_QUOTING"), (line(_3='"366.3"x'), "BROKEN_QUOTING"), (line(_3='3"66.3'), "BROKEN_QUOTING"), (line(_3='"366.3""'), "BROKEN_QUOTING"),
        (line(_3=' "366.3"'), "BROKEN_QUOTING"), ('"', "BROKEN_QUOTING"), (line(_11='x"') + ",1,2", "BROKEN_QUOTING"), (GOOD + "\r\r", "BAR"),
        ("", "COLUMN_COUNT"), (None, "COLUMN_COUNT"), ("   ", "COLUMN_COUNT"), (GOOD + ",", "COLUMN_COUNT"), (GOOD.replace(",", ";"), "COLUMN_COUNT"), (",".join(F[:11]), "COLUMN_COUNT"),
        (line(_0="171057600000"), "INVALID_VALUE"), (line(_6="1710576000000"), "INVALID_VALUE"), (line(_1="0"), "INVALID_VALUE"), (line(_1="NaN"), "INVALID_VALUE"),
        (line(_2="-inf"), "INVALID_VALUE"), (line(_2="1e999"), "INVALID_VALUE"), (line(_5="-1"), "INVALID_VALUE"), (line(_8="12.5"), "INVALID_VALUE"), (line(_8=""), "INVALID_VALUE"),
        (line(_4="1_000"), "INVALID_VALUE"), (line(_4="0x1F"), "INVALID_VALUE"), (line(_4="1e"), "INVALID_VALUE"), (line(_8="-4"), "INVALID_VALUE"), (line(_4="٣"), "INVALID_VALUE"),
    ])
def test_reasons(text, want):
    r = parse_line(text)
    assert (r[1] or r[0]) == want


def test_a_long_line_neither_recurses_nor_stalls():
    assert parse_line(line(_11='"' + '""' * 200_000 + '"'))[0] == "BAR"
    assert parse_line(line(_11='"' + '""' * 200_000))[1] == "BROKEN_QUOTING"


@given(st.text(alphabet='",0123456789.\r x', max_size=60))
@settings(max_examples=300, deadline=None)
def test_every_line_gets_one_verdict(text):
    assert parse_line(text)[0] in {"BAR", "HEADER", "FAIL"}


def test_errors_are_located():
    assert parse_line(line(_3='"366.3"x'))[:4] == ("FAIL", "BROKEN_QUOTING", 4, len(",".join(F[:3])) + 1 + 8)


def test_recovery_at_the_next_record_start():
    text = "\n".join(["open_time,open", GOOD, line(_3='"366'), "left, over", GOOD, line(_11='"two\nlines"'), "junk", GOOD]) + "\n"
    got = [(n, r[1] or r[0]) for n, r in parse_text(text)]
    assert got == [(1, "HEADER"), (2, "BAR"), (3, "BROKEN_QUOTING"), (5, "BAR"), (6, "BAR"), (8, "COLUMN_COUNT"), (9, "BAR")]


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, GOOD, "x", "y"), (2, None, None, None), (3, "open_time", "", ""), (1, GOOD, "x", "y")], "line_id long, raw_line string, reason string, open string")
    p = parse_bars(df)
    assert p.count() == 4
    assert [(r.line_id, r.reason) for r in failed_lines(p).collect()] == [(2, "COLUMN_COUNT")]
    b = loaded_bars(p).collect()
    assert len(b) == 2 and b[0].open == 368.1 and b[0].trade_count == 13699 and b[0].open_time.year == 2024
    assert parse_bars(df.where("false")).count() == 0
    (tmp_path / "a.csv").write_text(GOOD + "\n" + line(_3='"3') + "\n" + GOOD + "\n")
    f = read_bar_files(spark, str(tmp_path))
    assert sorted((r.line_no, r.parsed.status) for r in f.collect()) == [(1, "BAR"), (2, "FAIL"), (3, "BAR")]


def test_known_starts_end_what_a_broken_quote_swallows():
    lines = [GOOD, '"1,2', "x,y", GOOD + "\r", "", line(_1='"3'), GOOD]
    starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    got = list(parse_text("\n".join(lines), starts))
    assert [k for k, _ in got] == list(range(1, 8)) and [r[:2] for _, r in got] == [parse_line(x)[:2] for x in lines]
    # Without them the text up to the next line that begins as a record does belongs to the broken one.
    assert [(k, r[0]) for k, r in parse_text("\n".join(lines))] == [(1, "BAR"), (2, "FAIL"), (4, "BAR"), (5, "FAIL"), (6, "FAIL"), (7, "BAR")]
