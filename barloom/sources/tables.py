"""Parquet tables of a directory, with the columns an operator needs checked when the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory. Instants are UTC throughout, so the session's zone is set to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame itself; raises ValueError, before anything runs, when a column is absent."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
