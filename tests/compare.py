"""Order-free comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pandas as pd


def _cell(v) -> str:
    # NULL and NaN are alike here, as pandas holds both as NaN in a float column.
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)) or type(v).__module__ == "numpy" and type(v).__name__ != "bool":
        return f"{round(float(v), 5) + 0.0:.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    return Counter(tuple(map(_cell, r)) for r in df.itertuples(index=False))
