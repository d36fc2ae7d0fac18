"""Zipped archives with published checksums, bars from files, and synthetic bars."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.normalize import epoch_micros, epoch_unit
from barloom.operators.parsing import loaded_bars, parse_bars

BAR_SCHEMA = (
    "open_time timestamp, open double, high double, low double, close double, volume double, close_time timestamp, quote_volume double, "
    "trade_count long, taker_buy_volume double, taker_buy_quote_volume double")


_KINDS = dict(x.split() for x in BAR_SCHEMA.split(", "))
# Names under which archives carry the time and the rate of a funding event.
_FUNDING = (("calc_time", "open_time", "timestamp"), ("last_funding_rate", "funding_rate", "close"))


@dataclass(frozen=True)
class ArchivePath:
    """Where one month (YYYY-MM) or day (YYYY-MM-DD) of a series lies under a root."""

    market: str
    dataset: str
    symbol: str
    period: str
    interval: str | None = None

    def path(self, root: str) -> str:
        """Path, or address where ``root`` is one, of the archive. A month or day that no calendar has is an error."""
        cadence = {7: "monthly", 10: "daily"}.get(len(self.period))
        if cadence is None or self.market not in ("spot", "um", "cm"):
            raise ValueError("a period is YYYY-MM or YYYY-MM-DD, a market spot, um or cm")
        date.fromisoformat(self.period if cadence == "daily" else f"{self.period}-01")
        parts = [root.rstrip("/"), self.market, cadence, self.dataset, self.symbol, *([self.interval] if self.interval else [])]
        name = "-".join(x for x in (self.symbol, self.interval or self.dataset, self.period) if x)
        return "/".join([*parts, f"{name}.zip"])


def read_zip_lines(spark: SparkSession, path: str, checksums: DataFrame | None = None) -> DataFrame:
    """Lines of zipped archives with exactly one member each: archive_object, status, line_no, line.

    ``checksums`` (archive_object, sha256) is compared before anything is unpacked. An archive whose checksum
    differs (CHECKSUM_MISMATCH) or that is no zip of one member (BAD_ARCHIVE) gives one row without a
    line, so one bad file fails no job. An archive is unpacked by one task; it is one series' month.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive_object"), "content")
    if checksums is not None:
        c = checksums.select("archive_object", F.lower("sha256").alias("want_"))
        files = files.withColumn("have_", F.sha2("content", 256)).join(c, "archive_object", "left")
        bad = F.col("want_").isNull() | (F.col("want_") != F.col("have_"))
        files = files.select("archive_object", F.when(~bad, F.col("content")).alias("content"), bad.alias("mismatch"))
    else:
        files = files.withColumn("mismatch", F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive_object", "status", "line_no", "line"]
        for b in batches:
            for name, content, mismatch in zip(b["archive_object"], b["content"], b["mismatch"]):
                if mismatch:
                    yield pd.DataFrame([(name, "CHECKSUM_MISMATCH", None, None)], columns=names)
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        (member,) = z.namelist()
                        lines = z.read(member).decode("utf-8", "replace").split("\n")
                except (ValueError, zipfile.BadZipFile):
                    yield pd.DataFrame([(name, "BAD_ARCHIVE", None, None)], columns=names)
                    continue
                lines = lines[:-1] if lines and not lines[-1] else lines
                yield pd.DataFrame({"archive_object": name, "status": "OK", "line_no": range(1, len(lines) + 1), "line": lines})

    return files.mapInPandas(run, "archive_object string, status string, line_no long, line string")


def _as_instants(df: DataFrame, c: str) -> DataFrame:
    """A time column as timestamps: numbers as epochs of the unit their least magnitude shows, texts as ISO times. A text
    that is neither is an error."""
    if dict(df.dtypes)[c] in ("timestamp", "timestamp_ntz"):
        return df.withColumn(c, F.col(c).cast("timestamp"))
    n = F.col(c).try_cast("double")
    smallest, texts = df.agg(F.min(F.abs(n)), F.count_if(F.col(c).isNotNull() & n.isNull())).first()
    if texts or smallest is None:
        return df.withColumn(c, F.col(c).cast("timestamp"))
    return df.withColumn(c, F.timestamp_micros(epoch_micros(F.col(c).cast("decimal(38,0)"), epoch_unit(F.lit(smallest)))))


def canonical_bars(df: DataFrame) -> DataFrame:
    """Bars with instants as times, and numbers rounded half to even: quote volumes to 6 digits, others to 8."""
    for c in ("open_time", "close_time"):
        if c in df.columns:
            df = _as_instants(df, c)
    digits = lambda c: 6 if c in ("quote_volume", "taker_buy_quote_volume") else 8
    return df.select(*[F.bround(c, digits(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV (with a header), Parquet or zipped archives, by suffix, made canonical. Lines of an archive that are
    no bars are left out; any other suffix is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        texts = spark.read.option("header", True).csv(path)
        df = texts.select(*[F.col(c) if c in ("open_time", "close_time") or c not in _KINDS else F.col(c).try_cast(_KINDS[c]).alias(c) for c in texts.columns])
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix == "zip":
        df = loaded_bars(parse_bars(read_zip_lines(spark, path).where("status = 'OK'").select("line"), "line")).drop("line")
    else:
        raise ValueError("bars are CSV, Parquet or zipped archives")
    return canonical_bars(df)


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding events of zipped CSV archives with a header: symbol (from the name, before the first dash), timestamp and
    funding_rate. Columns go by any of their names; times are epoch milliseconds; a repeated time counts once; archives that
    cannot be read, and rows without a time, are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        f = pd.read_csv(io.BytesIO(z.read(next(n for n in z.namelist() if n.endswith(".csv")))))
                except (StopIteration, ValueError, zipfile.BadZipFile):
                    continue
                at, rate = (next((c for c in names if c in f.columns), None) for names in _FUNDING)
                if at and rate:
                    yield pd.DataFrame({"symbol": name.rsplit("/", 1)[-1].split("-")[0], "ms": pd.to_numeric(f[at], errors="coerce"), "funding_rate": pd.to_numeric(f[rate], errors="coerce")})

    e = files.mapInPandas(run, "symbol string, ms double, funding_rate double").where("ms is not null and not isnan(ms)")
    e = e.groupBy("symbol", "ms").agg(F.max("funding_rate").alias("funding_rate"))
    return e.select("symbol", F.timestamp_millis(F.col("ms").cast("long")).alias("timestamp"), F.nanvl("funding_rate", F.lit(None).cast("double")).alias("funding_rate"))


def synthetic_bars(spark: SparkSession, rows: int, minutes: int = 60, seed: int = 7) -> DataFrame:
    """A made-up series on a regular grid with every optional column, the same for the same seed: waves and noise, no
    market data. Fewer than 250 rows would not outlast the warm-up of the indicators and are an error."""
    if rows < 250:
        raise ValueError("at least 250 rows")
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1
    price = lambda i, k: 100 * F.exp(F.sin(i / F.lit(97.0)) * 0.1 + noise(k) * 0.004)
    d = spark.range(rows).withColumn("open", price(F.col("id"), 1)).withColumn("close", price(F.col("id") + 1, 2))
    d = d.withColumn("high", F.greatest("open", "close") * (1 + F.abs(noise(3)) * 0.002)).withColumn("low", F.least("open", "close") * (1 - F.abs(noise(4)) * 0.002))
    step = F.make_dt_interval(mins=F.lit(minutes))
    start = F.expr("timestamp'2020-01-01 00:00:00'")
    at = F.timestamp_micros(F.unix_micros(start) + F.col("id") * (minutes * 60_000_000))
    volume = 10 + 5 * noise(5)
    return d.select(
        at.alias("open_time"), "open", "high", "low", "close", volume.alias("volume"), (at + step - F.expr("interval 1 millisecond")).alias("close_time"),
        (volume * F.col("close")).alias("quote_volume"), F.floor(volume * 3).alias("trade_count"), (volume * (0.5 + 0.2 * noise(6))).alias("taker_buy_volume"),
        (volume * F.col("close") / 2).alias("taker_buy_quote_volume"), (F.col("close") * 0.9999).alias("bid_price"), (F.col("close") * 1.0001).alias("ask_price"),
        (5 + 2 * noise(7)).alias("bid_qty"), (5 + 2 * noise(8)).alias("ask_qty"), (1000 + 50 * noise(9)).alias("open_interest"), (0.0001 * noise(10)).alias("funding_rate"),
        (0.0005 * noise(11)).alias("premium"), (100 * F.exp(F.sin(F.col("id") / F.lit(211.0)) * 0.2)).alias("btc_close"), (0.5 + 0.4 * noise(12)).alias("breadth_pct_above_ema"))
