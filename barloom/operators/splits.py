"""Train, validation and test parts in time, and walk-forward folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chronological(df: DataFrame, pos: Column, n: Column, train: float = 0.6, validation: float = 0.2, embargo: int = 0) -> DataFrame:
    """Adds part by position of n rows: train, validation and test, with ``embargo`` positions behind either cut."""
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))
    part = (
        F.when(pos < a, "train").when(pos < a + embargo, "embargo").when(pos < b, "validation").when(pos < b + embargo, "embargo").otherwise("test"))
    return df.withColumn("part", part)


def calendar(df: DataFrame, us: Column, step_us: Column, train_end: int, validation_end: int, purge_bars: int, embargo_us: int) -> DataFrame:
    """Adds part by cuts in time all series share: a row whose outcome, ``purge_bars`` on, would cross a cut is
    purged; rows within the embargo behind a cut are left out of the part that follows."""
    reach = step_us * purge_bars
    part = (
        F.when(us < train_end - reach, "train")
        .when((us >= train_end + embargo_us) & (us < validation_end - reach), "validation")
        .when(us >= validation_end + embargo_us, "test").otherwise("purged"))
    return df.withColumn("part", part)


def walk_forward(n: int, min_train: int, validation: int, test: int, step: int, embargo: int = 0) -> list[dict[str, int]]:
    """Folds with a train part that grows from 0: positions from (included) and to (excluded) of each part."""
    if min(min_train, validation, test, step) < 1 or embargo < 0:
        raise ValueError("lengths must be positive")
    folds, end = [], min_train
    while (stop := end + embargo + validation + embargo + test) <= n:
        v = end + embargo
        folds.append({"fold": len(folds), "train_to": end, "validation_from": v, "validation_to": v + validation, "test_from": v + validation + embargo, "test_to": stop})
        end += step
    return folds


def _fold_parts(min_train: int, validation: int, test: int, embargo: int) -> list[tuple[str, int, int]]:
    """Part, first and end position in fold 0; the train part begins at 0 in every fold."""
    v = min_train + embargo
    t = v + validation + embargo
    return [("train", 0, min_train), ("validation", v, v + validation), ("test", t, t + test)]


def _last_fold(n: Column, stop: int, step: int) -> Column:
    """Number of the last fold whose test part, which ends at ``stop`` in fold 0, ends within n rows; -1 if none does."""
    return F.when(n >= stop, F.floor((n - stop) / F.lit(step))).otherwise(-1).cast("long")


def _from_to(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _tagged(folds: Column, part: str) -> Column:
    return F.transform(folds, lambda k: F.struct(k.cast("int").alias("fold"), F.lit(part).alias("part")))


def fold_table(df: DataFrame, n: Column, min_train: int, validation: int, test: int, step: int, embargo: int = 0) -> DataFrame:
    """``df``, one row per series of n rows, once per fold and part that ``walk_forward`` lays over n: adds fold, part,
    first and end (excluded). Nothing is built per fold on the driver, so n may be of any size."""
    walk_forward(0, min_train, validation, test, step, embargo)
    parts = _fold_parts(min_train, validation, test, embargo)
    k = F.col("fold").cast("long") * step
    rows = [F.struct(F.lit(p).alias("part"), (F.lit(a) + (0 if p == "train" else k)).cast("long").alias("first"), (F.lit(b) + k).cast("long").alias("end")) for p, a, b in parts]
    folds = df.select("*", F.explode(_from_to(F.lit(0).cast("long"), _last_fold(n, parts[-1][2], step))).alias("fold"))
    return folds.withColumn("fold", F.col("fold").cast("int")).select("*", F.inline(F.array(*rows)))


def in_folds(df: DataFrame, pos: Column, n: Column, min_train: int, validation: int, test: int, step: int, embargo: int = 0) -> DataFrame:
    """``df`` once per fold and part a row belongs to, of the folds ``walk_forward`` lays over n rows: adds fold and
    part. A row's folds follow from its position; no join. Train parts grow, so a row is in all later ones."""
    walk_forward(0, min_train, validation, test, step, embargo)
    parts, tags = _fold_parts(min_train, validation, test, embargo), []
    last = _last_fold(n, parts[-1][2], step)
    for part, a, b in parts:
        low = F.greatest(F.lit(0), F.floor((pos - b) / F.lit(step)) + 1).cast("long")
        high = last if part == "train" else F.least(last, F.floor((pos - a) / F.lit(step)).cast("long"))
        tags.append(_tagged(_from_to(low, high), part))
    return df.select("*", F.inline(F.concat(*tags)))


def growing_folds(df: DataFrame, pos: Column, n: Column, least_train: int = 50, least_part: int = 10) -> DataFrame:
    """Rows of the validation and test parts of walk-forward folds whose lengths follow from n: the first train part has half
    of n rows, validation and test a tenth each, and folds advance by a test part. Adds fold and part, and ``pos`` counts
    from the head of the part. A row is in at most one fold's validation and one fold's test part."""
    first, length = F.greatest(F.lit(least_train), F.floor(n / 2)), F.greatest(F.lit(least_part), F.floor(n / 10))
    last = F.floor((n - first - 2 * length) / length)
    tags = []
    for part, skip in (("validation", 0), ("test", 1)):
        k = F.floor((pos - first - skip * length) / length)
        ok = (pos < n) & (k >= 0) & (k <= last)
        tags.append(F.when(ok, F.struct(k.cast("int").alias("fold"), F.lit(part).alias("part"), (pos - first - skip * length - k * length).cast("long").alias("at_"))))
    return df.select("*", F.inline(F.array_compact(F.array(*tags)))).withColumn("pos", F.col("at_")).drop("at_")


def selected(summaries: DataFrame, keys: Sequence[str], name: str, score: str) -> DataFrame:
    """Per key (a fold): the name with the highest validation ``score`` (equal ones: the first name), and its trades and
    score in the test part, NULL and 0 where it does not trade there. ``summaries`` has part, trade_count and score."""
    v = summaries.where((F.col("part") == "validation") & (F.col("trade_count") > 0) & F.col(score).isNotNull())
    top = v.groupBy(*keys).agg(F.max(score).alias("validation_score"))
    best = v.join(top, list(keys)).where(F.col(score) == F.col("validation_score")).groupBy(*keys, "validation_score").agg(F.min(name).alias(name))
    t = summaries.where(F.col("part") == "test").select(*keys, name, F.col("trade_count").alias("test_trades"), F.col(score).alias("test_score"))
    return best.join(t, [*keys, name], "left").withColumn("test_trades", F.coalesce("test_trades", F.lit(0)))


def purge_bars(hours: float, minutes_per_bar: float) -> int:
    """Bars that an outcome ``hours`` on takes."""
    return math.ceil(hours * 60 / minutes_per_bar)
