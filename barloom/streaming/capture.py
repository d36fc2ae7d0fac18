"""Streams: an append-only event log, and bars built from a stream of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.normalize import json_field


def routed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Events with the symbol and market their JSON payload names, flat or nested under o; unknown where none does."""
    p = F.col(payload)
    kind = json_field(p, "$.market_type", "$.marketType", "$.st")
    market = F.when(kind == "1", "um").when(kind == "2", "cm").otherwise(kind)
    return events.withColumn("symbol", F.coalesce(json_field(p, "$.o.s", "$.s"), F.lit("unknown"))).withColumn("market", F.coalesce(market, F.lit("unknown")))


def envelope(events: DataFrame, stream: str, payload: str = "payload") -> DataFrame:
    """Routed events as they are kept: received_at, stream, market, symbol and the payload as it came."""
    e = routed(events, payload)
    at = F.col("received_at") if "received_at" in events.columns else F.current_timestamp()
    return e.select(at.alias("received_at"), F.lit(stream).alias("stream"), "market", "symbol", F.col(payload).alias("payload"))


def run_for(query: StreamingQuery, seconds: float) -> int:
    """Lets a query run for so long at most, stops it and returns how many rows it has read."""
    query.awaitTermination(seconds)
    read = sum(p["numInputRows"] if isinstance(p, dict) else p.numInputRows for p in query.recentProgress)
    if query.isActive:
        query.stop()
    return read


def append_log(events: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = ("market", "symbol")) -> StreamingQuery:
    """Writes what is there now as JSON lines per partition, each event once; a restart goes on where it ended."""
    w = events.writeStream.format("json").partitionBy(*partition).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(availableNow=True).start(path)


def bars_from_trades(trades: DataFrame, keys: Sequence[str], time: str, price: str, quantity: str, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Bars of fixed width from trades, batch or stream. On a stream a bar is emitted once the watermark (event time
    less ``delay``) has passed its end; later trades are dropped, as is usual of an appended aggregate."""
    t = trades.withWatermark(time, delay) if trades.isStreaming else trades
    at = F.struct(F.col(time), F.col(price))
    g = t.groupBy(*keys, F.window(time, width).alias("w_")).agg(
        F.min(at)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at)[price].alias("close"),
        F.sum(quantity).alias("volume"), F.count("*").alias("trade_count"))
    return g.select(*keys, F.col("w_.start").alias("open_time"), "open", "high", "low", "close", "volume", "trade_count")
