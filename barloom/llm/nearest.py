"""Records of two streams paired with the nearest in time, per entity and within a tolerance.

The join keeps state as a stream join does: both sides are buffered per entity; a left row is emitted
once the watermark has passed its tolerance horizon, when no nearer right row can still come; right rows
that no waiting or future left row can reach are evicted. nearest_stream runs this over live streams.
nearest_replay runs the same stateful query over bounded tables, which it feeds to the stream slice by slice in
the order of event time, so that rows that were delivered late or backfilled are not late any more and the
watermark drops none. nearest_join replays the same buffer in one batch job, without a state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.materialize import new_path, written
from barloom.sources.tables import require_columns

#: Rows that one slice of a replay holds, which is what its state may grow to, and slices it has at least.
SLICE_ROWS, LEAST_SLICES = 50_000_000, 2
#: Rows of one entity that one state holds, about; entities with more are cut into spans of time.
GROUP_ROWS = 250_000
#: Microseconds of event time that one task replays of one entity; a hot entity is split over many.
SPAN_US = 6 * 3_600_000_000
NONE = np.zeros(0, np.int64)


class NearestBuffer:
    """State of one entity: left rows that wait, right rows that may still be wanted."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.left_t, self.left_id = NONE, NONE
        self.right_t, self.right_id, self.right_v = NONE, NONE, np.zeros(0)

    def add_left(self, t: np.ndarray, ids: np.ndarray) -> None:
        self.left_t, self.left_id = np.append(self.left_t, t), np.append(self.left_id, ids)

    def add_right(self, t: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """Rows with a null value are no candidates."""
        ok = ~np.isnan(values)
        t, ids, values = np.append(self.right_t, t[ok]), np.append(self.right_id, ids[ok]), np.append(self.right_v, values[ok])
        order = np.lexsort((ids, t))
        self.right_t, self.right_id, self.right_v = t[order], ids[order], values[order]

    def advance(self, watermark: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emits (left id, left time, right id, right time, value) for the left rows whose horizon lies
        before the watermark (None: the stream has ended), those without a partner included with right id
        -1, and evicts what can no longer be reached. Of equally near right rows the earlier wins, then the
        smaller id."""
        due = np.ones(len(self.left_t), bool) if watermark is None else self.left_t + self.tolerance < watermark
        t, ids = self.left_t[due], self.left_id[due]
        self.left_t, self.left_id = self.left_t[~due], self.left_id[~due]
        n = len(self.right_t)
        partner, at, value = np.full(len(t), -1, np.int64), np.zeros(len(t), np.int64), np.full(len(t), np.nan)
        if n and len(t):
            after = np.searchsorted(self.right_t, t, "left")
            late = np.minimum(after, n - 1)
            # Rows of one time stand together, the smallest id first.
            early = np.searchsorted(self.right_t, self.right_t[np.maximum(after - 1, 0)], "left")
            far = np.iinfo(np.int64).max
            d_early = np.where(after > 0, t - self.right_t[early], far)
            d_late = np.where(after < n, self.right_t[late] - t, far)
            best = np.where(d_early <= d_late, early, late)
            near = np.minimum(d_early, d_late) <= self.tolerance
            partner[near], at[near], value[near] = self.right_id[best[near]], self.right_t[best[near]], self.right_v[best[near]]
        if watermark is not None:
            reach = min(int(self.left_t.min()) if len(self.left_t) else watermark, watermark) - self.tolerance
            keep = self.right_t >= reach
            self.right_t, self.right_id, self.right_v = self.right_t[keep], self.right_id[keep], self.right_v[keep]
        return ids, t, partner, at, value


def _sides(left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: str, left_time: str, right_id: str, right_time: str, value: str) -> tuple[DataFrame, DataFrame]:
    require_columns(left, {*entity, left_id, left_time})
    require_columns(right, {*entity, right_id, right_time, value})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lf = left.select(*entity, us(left_time).alias("t"), F.lit(0).cast("byte").alias("side"), F.col(left_id).cast("long").alias("id"), F.lit(None).cast("double").alias("v"))
    rf = right.select(*entity, us(right_time).alias("t"), F.lit(1).cast("byte").alias("side"), F.col(right_id).cast("long").alias("id"), F.col(value).cast("double").alias("v"))
    there = F.col("t").isNotNull() & F.col("id").isNotNull()
    for e in entity:
        there = there & F.col(e).isNotNull()
    return lf.where(there), rf.where(there & F.col("v").isNotNull() & ~F.isnan("v"))


def nearest_join(
    left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: str, left_time: str, right_id: str,
    right_time: str, value: str, tolerance_us: int, keep_unmatched: bool = False, span_us: int = SPAN_US,
) -> DataFrame:
    """(entity, left_id, left_us, right_id, right_us, value): each left id with the right row nearest in
    time, earlier or later, at most ``tolerance_us`` away. Ties go to the earlier, then to the smaller id.

    Rows with a null entity, id or time take no part, nor do right rows with a null or NaN value. A left
    id that is repeated at one time comes out once. With ``keep_unmatched`` left rows without a partner come
    out with nulls. An empty side gives no matches. Columns besides those named are ignored.

    Entities are cut into spans of event time, and right rows within the tolerance of a border are
    copied across it, so one entity with a third of all rows is replayed by many tasks. One shuffle.
    """
    lf, rf = _sides(left, right, entity, left_id, left_time, right_id, right_time, value)
    span = lambda t: F.floor(t / F.lit(span_us)).cast("long")
    t = F.col("t")
    lf = lf.withColumn("span", span(t))
    rf = rf.withColumn("span", F.explode(F.sequence(span(t - tolerance_us), span(t + tolerance_us))))
    keys = [*entity, "span"]
    both = lf.unionByName(rf).repartition(*keys).sortWithinPartitions(*keys, "t", "side", "id")
    kinds = dict(lf.dtypes)
    schema = ", ".join([*(f"`{e}` {kinds[e]}" for e in entity), "left_id long, left_us long, right_id long, right_us long, value double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # All groups of the partition are replayed on one clock, on which a group begins more than twice the
        # tolerance behind the one before: whole batches are buffered, matched and evicted at once.
        buffer, clock, last = NearestBuffer(tolerance_us), 0, None
        waiting: pd.DataFrame | None = None

        def out(watermark: int | None) -> pd.DataFrame:
            nonlocal waiting
            due = np.ones(len(waiting), bool) if watermark is None else buffer.left_t + tolerance_us < watermark
            f, waiting = waiting[due].reset_index(drop=True), waiting[~due]
            _, at, rid, rt, v = buffer.advance(watermark)
            ok = rid >= 0
            f["right_id"] = pd.Series(rid, dtype="Int64").mask(~ok)
            f["right_us"] = pd.Series(f["left_us"].to_numpy() + rt - at, dtype="Int64").mask(~ok)
            f["value"] = v
            return f[ok | keep_unmatched]

        for b in batches:
            if not len(b):
                continue
            t, ids, v = b["t"].to_numpy(np.int64), b["id"].to_numpy(np.int64), b["v"].to_numpy(float)
            is_left = b["side"].to_numpy() == 0
            new = np.zeros(len(b), bool)
            for k in keys:
                x = b[k].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            head = tuple(b[k].iloc[0] for k in keys)
            new[0] = last is None or head != last[0]
            step = np.diff(t, prepend=t[0] if last is None else last[1])
            step[new] = 2 * tolerance_us + 1
            now = clock + np.cumsum(step)
            # Repeats of a left row are neighbours.
            again = np.zeros(len(b), bool)
            again[1:] = is_left[1:] & is_left[:-1] & ~new[1:] & (ids[1:] == ids[:-1]) & (t[1:] == t[:-1])
            again[0] = last is not None and not new[0] and bool(is_left[0]) and last[1:] == (t[0], ids[0], True)
            take = is_left & ~again
            buffer.add_left(now[take], ids[take])
            buffer.add_right(now[~is_left], ids[~is_left], v[~is_left])
            rows = b.loc[take, list(entity)].copy()
            rows["left_id"], rows["left_us"] = ids[take], t[take]
            waiting = rows if waiting is None else pd.concat([waiting, rows])
            clock, last = int(now[-1]), (tuple(b[k].iloc[-1] for k in keys), t[-1], ids[-1], bool(is_left[-1]))
            yield out(clock)
        if waiting is not None:
            yield out(None)

    return both.mapInPandas(run, schema)


def nearest_stream(
    left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: str, left_time: str, right_id: str,
    right_time: str, value: str, tolerance_us: int, delay: str = "10 minutes",
) -> DataFrame:
    """The same over two streaming DataFrames: state per entity lives in the state store, the watermark is
    the event time seen less ``delay``, and a timer per entity emits what became due. A row that arrives
    behind the watermark has missed its partners and is dropped, which is the price of bounded state;
    what still waits when a query is stopped is emitted after it goes on. Output as nearest_join, unmatched
    left rows included (append mode)."""
    lf, rf = _sides(left, right, entity, left_id, left_time, right_id, right_time, value)
    return _stateful(lf.unionByName(rf), entity, entity, tolerance_us, delay)


def _output(both: DataFrame, entity: Sequence[str]) -> str:
    kinds = dict(both.dtypes)
    return ", ".join([*(f"`{e}` {kinds[e]}" for e in entity), "left_id long, left_us long, right_id long, right_us long, value double"])


def _stateful(both: DataFrame, keys: Sequence[str], entity: Sequence[str], tolerance_us: int, delay: str) -> DataFrame:
    """The stateful query over a stream of both sides; ``keys`` begin with ``entity``."""
    import pickle

    from pyspark.sql.streaming.state import GroupStateTimeout

    both = both.withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer = pickle.loads(state.get[0]) if state.exists else NearestBuffer(tolerance_us)
        for b in batches:
            is_left = b["side"].to_numpy() == 0
            t, ids, v = b["t"].to_numpy(np.int64), b["id"].to_numpy(np.int64), b["v"].to_numpy(float)
            buffer.add_left(t[is_left], ids[is_left])
            buffer.add_right(t[~is_left], ids[~is_left], v[~is_left])
        mark = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((buffer.left_id, buffer.left_t))
        t, ids = buffer.left_t[order], buffer.left_id[order]
        # Repeats of a left row that wait together are one.
        new = np.append(True, (t[1:] != t[:-1]) | (ids[1:] != ids[:-1]))[:len(t)]
        buffer.left_t, buffer.left_id = t[new], ids[new]
        ids, lt, rid, rt, val = buffer.advance(mark)
        if len(buffer.left_t):
            state.update((pickle.dumps(buffer),))
            due = (int(buffer.left_t.min()) + tolerance_us) // 1000 + 1
            state.setTimeoutTimestamp(max(due, mark // 1000 + 1))
        elif len(buffer.right_t):
            state.update((pickle.dumps(buffer),))
            state.setTimeoutTimestamp(max(int(buffer.right_t.max() + 2 * tolerance_us) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if not len(ids):
            return
        ok = rid >= 0
        f = pd.DataFrame({e: pd.Series([k] * len(ids), dtype=object) for e, k in zip(entity, key)})
        f["left_id"], f["left_us"] = ids, lt
        f["right_id"], f["right_us"] = pd.Series(rid, dtype="Int64").mask(~ok), pd.Series(rt, dtype="Int64").mask(~ok)
        f["value"] = val
        yield f

    return both.groupBy(*keys).applyInPandasWithState(run, _output(both, entity), "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)


def _span_us(both: DataFrame, entity: Sequence[str], tolerance_us: int, rows: int) -> int:
    """Longest span of time of which no entity has more than ``rows`` rows, never shorter than eight tolerances."""
    hours = written(both.groupBy(*entity, F.floor(F.col("t") / F.lit(3_600_000_000)).alias("hour_")).agg(F.count("*").alias("n_")), "density")
    for span in (720, 168, 24, 6):
        n = hours.groupBy(*entity, F.floor(F.col("hour_") / F.lit(span))).agg(F.sum("n_").alias("n")).agg(F.max("n")).first()[0]
        if n <= rows:
            break
    return max(span * 3_600_000_000 // (1 if n <= rows else -(-n // rows)), 8 * tolerance_us)


def nearest_replay(
    left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: str, left_time: str, right_id: str, right_time: str, value: str, tolerance_us: int,
    keep_unmatched: bool = False, slice_rows: int = SLICE_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The result of nearest_join, ties, nulls, repeats and empty tables included, by the streaming join.

    Both tables are written once in order of time and appended to the stream's folder in slices of about ``slice_rows``
    rows; after each the stream runs until it has nothing left to do, its state and watermark kept in its checkpoint.
    A last slice far ahead moves the watermark past everything, so that all that waits is emitted. State is held per
    entity and span of time, so neither an entity with a third of all rows nor a long history is one state's work;
    right rows within the tolerance of a border are in both spans.
    """
    spark = left.sparkSession
    lf, rf = _sides(left, right, entity, left_id, left_time, right_id, right_time, value)
    both = written(lf.unionByName(rf).repartitionByRange("t").sortWithinPartitions("t"), "replay")
    out = _output(both, entity)
    n, last = both.agg(F.count("*"), F.max("t")).first()
    if not n:
        return spark.createDataFrame([], out)
    span_us = _span_us(both, entity, tolerance_us, group_rows)
    span = lambda t: F.floor(t / F.lit(span_us)).cast("long")
    t = F.col("t")
    both = both.withColumn("span", F.explode(F.when(F.col("side") == 0, F.array(span(t))).otherwise(F.sequence(span(t - tolerance_us), span(t + tolerance_us)))))
    slices = max(LEAST_SLICES, -(-n // slice_rows))
    edges = sorted({int(e) for e in both.approxQuantile("t", [k / slices for k in range(1, slices)], 0.02 / slices)})
    folder, found, state = new_path(spark, "slices"), new_path(spark, "pairs"), new_path(spark, "state")
    end = both.limit(1).withColumn("t", F.lit(last + 2 * tolerance_us + 3_600_000_000)).withColumn("side", F.lit(1).cast("byte")).withColumn(
        "v", F.lit(0.0)).withColumn("span", F.lit(-1).cast("long"))
    parts = [both.where((t >= a if a is not None else F.lit(True)) & (t < z if z is not None else F.lit(True))) for a, z in zip([None, *edges], [*edges, None])]
    for part in [*parts, end]:
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(both.schema).parquet(folder)
        pairs = _stateful(stream, [*entity, "span"], entity, tolerance_us, "1 second")
        q = pairs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(found)
        q.awaitTermination()
    pairs = spark.read.schema(out).parquet(found)
    return pairs if keep_unmatched else pairs.where(F.col("right_id").isNotNull())
