"""Zone transition tables: offsets by instant, and wall-clock times back to instants, on whole arrays."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, ZoneInfoNotFoundError

import numpy as np

FIRST_YEAR, LAST_YEAR = 1800, 2500
_UTC = timezone.utc
_EPOCH = datetime(1970, 1, 1, tzinfo=_UTC)


@lru_cache(None)
def version() -> str:
    """Release of the zone data in use, such as 2025b; tables of different releases may differ."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    for folder in TZPATH:
        for name, mark in (("tzdata.zi", "# version "), ("+VERSION", "")):
            p = Path(folder, name)
            if p.exists():
                return p.open().readline().removeprefix(mark).strip()
    return "unknown"


@lru_cache(None)
def transitions(zone: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants at which the offset changes, offsets before, between and after them), in seconds.
    None for an unknown zone."""
    try:
        z = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    offset = lambda s: int((_EPOCH + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    day = 86_400
    lo = int((datetime(first_year, 1, 1, tzinfo=_UTC) - _EPOCH).total_seconds())
    hi = int((datetime(last_year, 1, 1, tzinfo=_UTC) - _EPOCH).total_seconds())
    at, offsets, before = [], [offset(lo)], offset(lo)
    for s in range(lo + day, hi, day):
        now = offset(s)
        if now != before:
            a, b = s - day, s
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == before else (a, m)
            at.append(b)
            offsets.append(now)
            before = now
    return np.array(at, np.int64), np.array(offsets, np.int64)


#: Rules repeat with the calendar, every 400 years; before the first table every zone keeps its local mean time.
CYCLE_S = 146_097 * 86_400
_FIRST_S = int((datetime(FIRST_YEAR, 1, 2, tzinfo=_UTC) - _EPOCH).total_seconds())
_LAST_S = int((datetime(LAST_YEAR, 1, 1, tzinfo=_UTC) - _EPOCH).total_seconds())


def to_instants(wall: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wall-clock seconds to (earliest, latest, how many) instants: 0 where the zone skips the time,
    2 where it occurs twice. An unknown zone gives 0 throughout. Any year is converted: one beyond the tables
    as the year some 400s before it, which has the same calendar and rules, one before them by the first offset."""
    early, late, count = (np.zeros(len(wall), np.int64) for _ in range(3))
    moved = np.maximum(0, -(-(wall - _LAST_S) // CYCLE_S)) * CYCLE_S + np.minimum(0, wall - _FIRST_S)
    wall = wall - moved
    # A table per quarter century, so that it covers no more years than are needed.
    quarter = (1970 + wall // 31_556_952) // 25
    for q in np.unique(quarter).tolist():
        r = np.flatnonzero(quarter == q)
        if (t := transitions(zone, max(FIRST_YEAR, 25 * q - 2), 25 * q + 27)) is None:
            continue
        early[r], late[r], count[r] = _by_table(wall[r], *t)
    return early + moved, late + moved, count


def _by_table(wall: np.ndarray, at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = lambda s: off[np.searchsorted(at, s, side="right")]
    before, after = of(wall - 86_400), of(wall + 86_400)
    a, b = wall - before, wall - after
    ok_a, ok_b = of(a) == before, (of(b) == after) & (a != b)
    n = ok_a.astype(np.int64) + ok_b
    first, second = np.where(ok_a, a, b), np.where(ok_b, b, a)
    return np.minimum(first, second), np.maximum(first, second), n
