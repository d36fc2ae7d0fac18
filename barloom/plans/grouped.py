"""Whole groups in Arrow batches: many small groups per call instead of one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Called with the rows of whole groups, in order, and where each group starts and ends.
Groups = Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]


def bounds(b: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a new group begins, the first one included."""
    new = np.zeros(len(b), bool)
    new[:1] = True
    for k in keys:
        x = b[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Groups, ddl: str, tasks: int = 0) -> DataFrame:
    """One shuffle on ``keys`` and one sort, then ``fn`` over batches of whole groups. Keys must not be NULL. A
    group is held in memory, so keys must bound it (a chunk, a run's summary), which every caller here ensures.
    With ``tasks`` the shuffle has so many partitions, which adaptive execution does not join."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if rest:
                last = rest[-1][keys].iloc[-1].tolist()
                if (b[keys].iloc[-1].tolist() == last) and len(bounds(b, keys)) == 1:
                    rest.append(b)
                    continue
                b = pd.concat([*rest, b], ignore_index=True)
            at = bounds(b, keys)
            if len(at) > 1:
                yield fn(b.iloc[:at[-1]], at[:-1], at[1:])
            rest = [b.iloc[at[-1]:]]
        if rest:
            b = pd.concat(rest, ignore_index=True)
            yield fn(b, np.array([0]), np.array([len(b)]))

    return (df.repartition(tasks, *keys) if tasks else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, ddl)
