"""Partitioned panels, append-only registries and result tables."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import require_columns


def write_panel(df: DataFrame, path: str, time: str, keys: Sequence[str] = ("market", "symbol", "timeframe"), monthly: bool = False) -> None:
    """Panel rows under market=/symbol=/timeframe=/year= (and month=), sorted by time within files. A hot series is
    spread over files by month; partitions that the frame has are replaced, others stay."""
    require_columns(df, {*keys, time})
    d = df.withColumn("year", F.year(time)).withColumn("month", F.month(time))
    parts = [*keys, "year", *(["month"] if monthly else [])]
    d = d.repartition(*keys, "year", "month").sortWithinPartitions(*parts, time)
    if not monthly:
        d = d.drop("month")
    d.write.partitionBy(*parts).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_revisions(known: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``known`` does not have yet; of equal new keys one. detected_at and status, where missing,
    are now and DETECTED."""
    for c, x in (("detected_at", F.current_timestamp()), ("status", F.lit("DETECTED"))):
        new = new.withColumn(c, F.coalesce(F.col(c), x) if c in new.columns else x)
    return new.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti")


def append_record(path: str, record: dict) -> None:
    """One JSON line with sorted keys at the end of a registry file, flushed to disk."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o644)
    try:
        os.write(fd, (json.dumps(record, sort_keys=True) + "\n").encode())
        os.fsync(fd)
    finally:
        os.close(fd)


def write_tables(tables: dict[str, DataFrame], folder: str, known: Sequence[str]) -> None:
    """Small result tables as one CSV each. An unknown name is an error; a known one without a table gets a row that
    says so."""
    if extra := sorted(set(tables) - set(known)):
        raise ValueError(f"unknown tables: {', '.join(extra)}")
    for name in known:
        if name in tables:
            t = tables[name].coalesce(1)
        else:
            t = next(iter(tables.values())).sparkSession.createDataFrame([("INSUFFICIENT EVIDENCE",)], "status string").coalesce(1)
        t.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a registry file, blank lines skipped."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path)


def write_report(path: str, title: str, metadata: dict, strongest: Sequence[dict]) -> None:
    """A Markdown report: the metadata as JSON, and a table of the strongest rows, or a line that says there are none."""
    lines = [f"# {title}", "", "```json", json.dumps(metadata, indent=2, sort_keys=True, default=str), "```", ""]
    if strongest:
        columns = list(strongest[0])
        lines += [f"| {' | '.join(columns)} |", f"|{'-|' * len(columns)}", *[f"| {' | '.join(str(r.get(c, '')) for c in columns)} |" for r in strongest]]
    else:
        lines.append("INSUFFICIENT EVIDENCE")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def write_processed(bars: DataFrame, path: str) -> None:
    """Typed bars as parquet, in order of time within each file."""
    require_columns(bars, {"open_time"})
    bars.sortWithinPartitions("open_time").write.mode("overwrite").parquet(path)
