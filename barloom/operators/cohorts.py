"""Monthly volumes and ranked cohorts, changes of membership, breadth, and the census of archive objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import number
from barloom.sources.tables import require_columns

CUTS = (20, 50, 100)


def month_volume(daily: DataFrame, keys: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """Per key and month of ``day`` (a date): sum of quote_volume, days observed and expected, coverage, the
    month after it, and the key's first observed day."""
    require_columns(daily, {*keys, "day", "quote_volume"})
    m = daily.groupBy(*keys, F.date_trunc("month", "day").cast("date").alias("m_")).agg(
        F.sum(number(F.col("quote_volume"))).alias("quote_volume"), F.countDistinct("day").alias("observed_days"), F.min("day").alias("first_day_"))
    expected = F.dayofmonth(F.last_day("m_"))
    first = F.min("first_day_").over(Window.partitionBy(*keys))
    return m.select(
        *keys, F.date_format("m_", "yyyy-MM").alias("volume_month"), F.date_format(F.add_months("m_", 1), "yyyy-MM").alias("universe_month"),
        "quote_volume", "observed_days", expected.alias("expected_days"), (F.col("observed_days") / expected).alias("coverage_ratio"),
        F.date_format(first, "yyyy-MM-dd").alias("first_observed"))


def ranked_universe(volumes: DataFrame, group: Sequence[str], item: str, volume: str, eligible: Column, cuts: Sequence[int] = CUTS) -> DataFrame:
    """``volumes`` with rank_no among the eligible rows of a group (volume from the largest, then item) and
    selected_top{n} flags. Rows that are not eligible keep a NULL rank. The ranking sorts one group per task at
    most as large as its distinct items; for groups of millions take the N best only."""
    ok = F.coalesce(eligible & number(F.col(volume)).isNotNull(), F.lit(False))
    w = Window.partitionBy(*group, ok).orderBy(F.col(volume).desc(), F.col(item))
    r = volumes.withColumn("rank_no", F.when(ok, F.row_number().over(w)).cast("long"))
    return r.select("*", *[F.coalesce(F.col("rank_no") <= n, F.lit(False)).alias(f"selected_top{n}") for n in cuts])


def selected_universe(volumes: DataFrame, group: Sequence[str], verified: bool = False) -> DataFrame:
    """Symbols of a month ranked by the volume of the month before: group, symbol, volume, rank_no, reason and selected flags.
    ``volumes`` has volume, coverage, volume_month, first_observed and, in ``group``, universe_month.

    Eligible is who has a volume of 0 or more and was observed before the month began; ``verified``: before the volume's
    month began, and with that month covered in full (a NULL coverage is none, yet gives no reason). Otherwise reason is
    NEGATIVE_VOLUME, NO_VOLUME, PARTIAL_PRIOR_MONTH or NOT_OBSERVED, the first that holds. ``verified`` volumes of
    another month than the one before are an error."""
    month = F.to_timestamp(F.concat(F.col("universe_month"), F.lit("-01")), "yyyy-MM-dd")
    prior = F.add_months(month, -1)
    unseen = F.coalesce(F.col("first_observed").cast("timestamp") >= (prior.cast("timestamp") if verified else month), F.lit(True))
    short = F.lit(verified) & F.coalesce(F.isnan("coverage") | (F.col("coverage") < 1), F.lit(False))
    covered = F.lit(True) if not verified else number(F.col("coverage")) >= 1
    reason = (
        F.when(F.col("volume") < 0, "NEGATIVE_VOLUME").when(F.col("volume").isNull(), "NO_VOLUME").when(short, "PARTIAL_PRIOR_MONTH").when(unseen, "NOT_OBSERVED").otherwise("ELIGIBLE"))
    v = volumes.withColumn("reason", reason).withColumn("ok_", (F.col("volume") >= 0) & ~unseen & covered)
    if verified:
        fits = F.col("volume_month") == F.date_format(prior, "yyyy-MM")
        v = v.where(F.when(~fits, F.raise_error(F.lit("a volume of another month than the one before"))).otherwise(F.lit(True)))
    v = v.select(*group, "symbol", "volume", "reason", "ok_")
    return ranked_universe(v, group, "symbol", "volume", F.col("ok_")).drop("ok_")


def cohort_counts(ranked: DataFrame, group: Sequence[str], cuts: Sequence[int] = CUTS) -> DataFrame:
    """Candidates, ranked rows and rows within each cut per group."""
    return ranked.groupBy(*group).agg(
        F.count("*").alias("candidate_count"), F.count("rank_no").alias("eligible_count"),
        *[F.count_if(F.col("rank_no") <= n).alias(f"top{n}") for n in cuts])


def membership_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Members whose flags differ between two versions; a member absent on one side counts as False there."""
    a = before.select(*keys, *[F.col(f).alias(f"before_{f}") for f in flags])
    b = after.select(*keys, *[F.col(f).alias(f"after_{f}") for f in flags])
    j = a.join(b, list(keys), "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(False))
    changed = F.lit(False)
    for f in flags:
        changed = changed | (z(f"before_{f}") != z(f"after_{f}"))
    return j.where(changed).select(*keys, *[z(f"{s}_{f}").alias(f"{s}_{f}") for f in flags for s in ("before", "after")])


def breadth(values: DataFrame, group: Sequence[str], flag: Column, least_valid: float = 0.0) -> DataFrame:
    """Share of a group's rows whose flag holds, among those where it is not NULL; NULL, with status
    INSUFFICIENT_CROSS_SECTION, where fewer than ``least_valid`` of the rows are valid."""
    g = values.groupBy(*group).agg(F.count("*").alias("selected_count"), F.count(flag).alias("valid_count"), F.count_if(flag).alias("above_count"))
    enough = (F.col("valid_count") > 0) & (F.col("valid_count") >= least_valid * F.col("selected_count"))
    return g.withColumn("breadth", F.when(enough, F.col("above_count") / F.nullif(F.col("valid_count"), F.lit(0)))).withColumn(
        "status", F.when(enough, "AVAILABLE").otherwise("INSUFFICIENT_CROSS_SECTION"))


def archive_objects(keys: DataFrame, column: str = "key") -> DataFrame:
    """Parts of archive paths market/symbol/timeframe/name-YYYY-MM.ext: ``keys`` with market, symbol, timeframe and
    archive_month; paths of another shape are left out."""
    p = r"^([^/]+)/([^/]+)/([^/]+)/.*-([0-9]{4}-[0-9]{2})\.[a-z]+$"
    part = lambda i: F.regexp_extract(column, p, i)
    return keys.where(F.col(column).rlike(p)).select(
        *[c for c in keys.columns if c not in ("market", "symbol", "timeframe", "archive_month")], part(1).alias("market"), part(2).alias("symbol"),
        part(3).alias("timeframe"), part(4).alias("archive_month"))


def symbol_census(objects: DataFrame, keys: Sequence[str] = ("market", "symbol", "timeframe")) -> DataFrame:
    """Per key: first and last month, months present and missing in between, objects and lines."""
    m = F.to_date(F.concat("archive_month", F.lit("-01")))
    g = objects.groupBy(*keys).agg(
        F.min("archive_month").alias("first_month"), F.max("archive_month").alias("last_month"), F.countDistinct("archive_month").alias("months"),
        F.count("*").alias("objects"), F.sum("lines").alias("lines"), F.min(m).alias("a_"), F.max(m).alias("b_"))
    span = F.months_between("b_", "a_") + 1
    return g.withColumn("missing_months", (span - F.col("months")).cast("long")).drop("a_", "b_")
