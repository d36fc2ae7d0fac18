"""The N highest-scoring items of every group.

The candidates are written once, clustered by group and, within a group, by falling score. Parquet keeps
the range of groups, the range of scores and the number of rows of every row group. From these statistics
alone follows a floor for each group that has row groups of its own: its N-th score is at least the lowest
score of the best row groups that together hold N rows. Row groups whose highest score lies strictly below
the floors of all groups they hold are never opened, in whichever file they are. The others are read in
descending order of their highest score, and one that has meanwhile fallen strictly below the N-th score of
its groups is skipped as well. A last ranking merges what the readers of one group kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.materialize import new_path, written
from barloom.sources.tables import require_columns

#: Bytes of one row group of the clustered layout, the unit that is read or skipped: a share of the table's size,
#: so that there are at most some thousands a terabyte, but within these bounds.
LEAST_BYTES, MOST_BYTES, SHARE = 32 * 1024, 4 * 1024 * 1024, 4096
ROW_GROUPS = "path string, row_group int, low string, high string, bottom double, top double, rows long"


def clustered(items: DataFrame, group: Sequence[str], score: str, item: str, row_group_bytes: int) -> str:
    """Writes the candidates in order of group, falling score and item, in small row groups, and returns the
    path. Ranges are cut by group, score and item, so a group of any size spreads over many files."""
    path = new_path(items.sparkSession, "clustered")
    order = [*group, F.col(score).desc(), F.col(item)]
    # Lengths keep apart groups whose columns only together read the same.
    key = F.concat_ws("\x1f", *[F.concat(F.length(F.col(g).cast("string")), F.lit(":"), F.col(g).cast("string")) for g in group])
    (items.select(key.alias("group_key"), *group, score, item)
     .repartitionByRange(*order).sortWithinPartitions("group_key", F.col(score).desc(), item)
     .write.option("parquet.block.size", str(row_group_bytes)).option("compression", "zstd").parquet(path))
    return path


def _open(path: str) -> pq.ParquetFile:
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return pq.ParquetFile(at.path)
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(name))


def row_groups(files: DataFrame, score: str) -> DataFrame:
    """ROW_GROUPS of the clustered files (``path``), from their footers. Statistics that a footer lacks leave NULLs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                meta = _open(path).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for r in range(meta.num_row_groups):
                    m = meta.row_group(r)
                    g, s = (m.column(at[c]).statistics for c in ("group_key", score))
                    known = g is not None and s is not None and g.has_min_max and s.has_min_max
                    out.append((path, r, *((g.min, g.max, s.min, s.max) if known else (None,) * 4), m.num_rows))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ROW_GROUPS.split(", ")])

    return files.select("path").mapInPandas(run, ROW_GROUPS)


def with_floors(groups: DataFrame, n: int) -> DataFrame:
    """ROW_GROUPS with ``floor``, what the N-th score of all groups of a row group is at least; NULL where it is unknown.

    Rows are sorted by group, so a row group that holds several groups holds the head of one of them, which no floor
    may hide: floors are those of row groups that lie within one group. N row groups of a group are enough to know
    it, whatever the group's size, as each has a row.
    """
    one = groups.where(F.col("low") == F.col("high"))
    w = Window.partitionBy("low").orderBy(F.col("bottom").desc(), "path", "row_group")
    best = one.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= n)
    best = best.withColumn("rows_", F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    floors = best.where(F.col("rows_") >= n).groupBy(F.col("low").alias("of_")).agg(F.max("bottom").alias("floor"))
    return groups.join(floors, (F.col("low") == F.col("of_")) & (F.col("low") == F.col("high")), "left").drop("of_")


def read_best(chunks: pd.DataFrame, n: int, score: str, columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The N best rows of each group in each row group that is read, of ROW_GROUPS in descending order of their highest
    score. What is remembered is the N-th score of groups that have a row group of their own, a number each."""
    files: dict[str, pq.ParquetFile] = {}
    nth: dict[str, float] = {}
    top = chunks["top"].fillna(np.inf)
    for c in chunks.assign(top=top).sort_values(["top", "path", "row_group"], ascending=[False, True, True], kind="stable").itertuples(index=False):
        if c.low is not None and c.low == c.high and c.top < nth.get(c.low, -np.inf):
            continue
        if c.path not in files:
            files[c.path] = _open(c.path)
        t = files[c.path].read_row_group(c.row_group, columns=["group_key", *columns])
        # Sorted by group and falling score: a group's best rows are the first of its run.
        key = t.column("group_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        kept = np.flatnonzero(np.arange(len(key)) - first[run] < n)
        out = t.select(list(columns)).take(kept).to_pandas()
        if c.low is not None and c.low == c.high and len(out) == n:
            nth[c.low] = max(nth.get(c.low, -np.inf), float(out[score].iloc[-1]))
        yield out


def _candidates(items: DataFrame, group: Sequence[str], score: str, item: str) -> DataFrame:
    require_columns(items, {*group, score, item})
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull()
    for g in group:
        ok = ok & F.col(g).isNotNull()
    return items.where(ok & (F.col(score) > float("-inf"))).select(*group, F.col(score).cast("double").alias(score), F.col(item).cast("string").alias(item))


def planned(items: DataFrame, group: Sequence[str], score: str, item: str, n: int = 10, row_group_bytes: int | None = None) -> DataFrame:
    """ROW_GROUPS of the clustered candidates with their floors: which of them top_n() opens, and why."""
    good = _candidates(items, group, score, item)
    if row_group_bytes is None:
        good = written(good, "candidates")
        size = good.count() * 8 * (len(group) + 2)
        row_group_bytes = min(MOST_BYTES, max(LEAST_BYTES, size // SHARE))
    path = clustered(good, group, score, item, row_group_bytes)
    files = items.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    # As many tasks as files: by the few bytes of their names adaptive execution would read them all in one.
    files = files.repartitionByRange(max(1, min(files.count(), 20_000)), "path")
    return written(with_floors(row_groups(files, score), n), "row-groups")


def top_n(
    items: DataFrame, group: Sequence[str], score: str, item: str, n: int = 10, row_group_bytes: int | None = None,
) -> DataFrame:
    """(group, item, score, rank_no): the ``n`` highest scores of each group, ranks 1 to ``n``; equal scores
    by ``item`` in ascending byte order. Items repeated with an equal score count as often as they occur.

    Null, NaN and negative-infinity scores and null items or group columns are no candidates. A group with
    fewer items comes out whole; an empty table gives no rows; other columns are ignored.
    """
    plan = planned(items, group, score, item, n, row_group_bytes)
    kinds = dict(_candidates(items, group, score, item).dtypes)
    columns = [*group, score, item]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task's list of row groups is short; their rows come one row group at a time.
        chunks = list(batches)
        if chunks:
            yield from read_best(pd.concat(chunks, ignore_index=True), n, score, columns)

    opened = plan.where(F.col("floor").isNull() | (F.col("top") >= F.col("floor")))
    tasks = max(1, min(opened.select("path").distinct().count(), 20_000))
    kept = opened.repartition(tasks, "path").mapInPandas(run, schema)
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item))
    ranked = kept.withColumn("rank_no", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank_no") <= n)
