"""Raw exchange rows to typed tables: epoch units, positional layouts, duplicate listings, routed payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positional columns of the archive datasets, and the magnitudes that tell epoch units apart.
LAYOUTS = {
    "klines": "open_time open high low close volume close_time quote_volume trade_count taker_buy_volume taker_buy_quote_volume ignore",
    "aggTrades": "agg_trade_id price quantity first_trade_id last_trade_id timestamp is_buyer_maker is_best_match",
    "trades": "trade_id price quantity quote_quantity timestamp is_buyer_maker is_best_match",
    "fundingRate": "timestamp funding_interval_hours funding_rate",
}
TIMES = {"klines": "open_time", "aggTrades": "timestamp", "trades": "timestamp", "fundingRate": "timestamp"}
UNITS = (("s", 1e8, 1_000_000.0), ("ms", 1e11, 1_000.0), ("us", 1e14, 1.0), ("ns", 1e17, 0.001))


def epoch_unit(smallest: Column) -> Column:
    """Unit of a column of epochs by its smallest magnitude: s, ms, us or ns; NULL below any plausible one."""
    a = F.abs(smallest)
    unit = F.lit(None).cast("string")
    for name, least, _ in UNITS:
        unit = F.when(a >= least, name).otherwise(unit)
    return unit


def epoch_micros(value: Column, unit: Column) -> Column:
    """Microseconds of an epoch in a unit."""
    v, out = value.cast("double"), F.lit(None).cast("long")
    for name, _, scale in UNITS:
        whole = value.cast("long")
        exact = whole * int(scale) if scale >= 1 else F.floor(v * scale)
        out = F.when(unit == name, exact).otherwise(out)
    return out.cast("long")


def units_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The epoch unit of each key's values. Values that are no numbers are ignored; a key without any has none."""
    n = F.col(value).try_cast("double")
    return df.groupBy(*keys).agg(F.min(F.abs(n)).alias("smallest"), F.count(n).alias("n")).withColumn("unit", epoch_unit(F.col("smallest")))


def positional(rows: DataFrame, dataset: str, fields: str = "fields") -> DataFrame:
    """Rows of an array of texts as the dataset's columns (texts), with those left out whose time is no number."""
    if dataset not in LAYOUTS:
        raise ValueError(f"unknown dataset {dataset}")
    names = LAYOUTS[dataset].split()
    out = rows.select(*[c for c in rows.columns if c != fields and c not in names], *[F.get(F.col(fields), i).alias(n) for i, n in enumerate(names)])
    return out.where(F.col(TIMES[dataset]).try_cast("double").isNotNull())


def aggressor_side(is_buyer_maker: Column) -> Column:
    """-1 where the buyer was the maker, 1 where the seller was, NULL where unknown."""
    return F.when(is_buyer_maker, -1).when(~is_buyer_maker, 1).cast("byte")


def json_field(payload: Column, *paths: str) -> Column:
    """The first of several paths of a JSON text that holds a value."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])
