"""Exponential moving averages as window expressions.

y(0) = x(0), y(t) = (1-a) y(t-1) + a x(t). In closed form y is a weighted prefix sum, which is computed in
blocks short enough for its weights to stay in range: inside a block a prefix sum of a x(i) (1-a)^-o, scaled
back, plus the last value of the block before times (1-a)^(o+1). A block is so long (37/a bars) that what lies
two blocks back weighs less than 1e-16.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.grouped import map_groups


def span(n: float) -> float:
    return 2.0 / (n + 1)


def wilder(n: float) -> float:
    return 1.0 / n


def with_ewm(df: DataFrame, outputs: dict[str, tuple[str, float, int]], keys: Sequence[str], order: str) -> DataFrame:
    """Adds an average per output name: (input column, smoothing, observations before the first value shows).

    Rows of ``keys`` are one run of values in ``order``; inputs may lack values at the head of a run but not
    inside it (see filled_ewm for that). Outputs of one smoothing share their blocks, windows and sort.
    """
    by_alpha: dict[float, list[str]] = {}
    for name, (_, alpha, _) in outputs.items():
        by_alpha.setdefault(alpha, []).append(name)
    w = Window.partitionBy(*keys).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    for alpha, names in by_alpha.items():
        q, size = 1.0 - alpha, math.ceil(37 / alpha)
        for name in names:
            x = F.col(outputs[name][0])
            df = df.withColumn(f"t_{name}", F.when(x.isNotNull(), F.count(x).over(upto) - 1))
        for name in names:
            x, t = F.col(outputs[name][0]), F.col(f"t_{name}")
            o = F.pmod(t, F.lit(size))
            weight = F.when(t == 0, 1.0).otherwise(alpha) * F.pow(F.lit(q), -o.cast("double"))
            in_block = Window.partitionBy(*keys, F.floor(t / F.lit(size))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            df = df.withColumn(f"b_{name}", F.sum(x * weight).over(in_block) * F.pow(F.lit(q), o.cast("double")))
        for name in names:
            t, b = F.col(f"t_{name}"), F.col(f"b_{name}")
            o = F.pmod(t, F.lit(size))
            carry = F.last(F.when(o == size - 1, b), True).over(before)
            y = b + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(q), (o + 1).cast("double"))
            df = df.withColumn(name, F.when(t >= outputs[name][2] - 1, y)).drop(f"t_{name}", f"b_{name}")
    return df


def filled_ewm(df: DataFrame, outputs: dict[str, tuple[str, float, int]], keys: Sequence[str], order: str) -> DataFrame:
    """The same for inputs with values missing inside a run: a value after g missing ones meets the old average
    at the weight (1-a)^(g+1), renormalised, and rows without a value carry the average on. Whole groups of
    ``keys`` in Arrow batches; keep groups to chunks."""
    schema = df.schema
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{n}` double" for n in outputs])

    def run(b: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        b = b.copy()
        for name, (x, alpha, least) in outputs.items():
            v = b[x].astype(float)
            b[name] = np.concatenate([v.iloc[a:z].ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy() for a, z in zip(first, end)])
        return b

    return map_groups(df, keys, [order], run, fields)
