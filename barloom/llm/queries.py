"""Queries of the operators for language-model training data (problems 3, 5, 8, 9 and 10)."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.language import label_languages
from barloom.llm.leaks import leaked_items
from barloom.llm.nearest import nearest_join, nearest_replay
from barloom.llm.packing import pack_documents
from barloom.llm.topn import planned, top_n
from barloom.sources.tables import table

GROUP = ("campaign_id", "market", "universe_month")
FIVE_MINUTES = 5 * 60_000_000


def _month(c: str) -> Column:
    """A month written YYYY-MM or YYYY-MM-DD as YYYY-MM; NULL for anything else."""
    return F.when(F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.substring(c, 1, 7))


def _last_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Of each symbol of a group the row recorded last. Combined before it is shuffled."""
    v = table(spark, d, "monthly_volume").withColumn("universe_month", _month("universe_month"))
    return v.groupBy(*GROUP, "symbol").agg(F.max_by("prior_month_quote_volume", "recorded_at").alias("prior_month_quote_volume"))


def p3_reads(spark: SparkSession, d: str) -> DataFrame:
    """Row groups of the clustered candidates, and those that the statistics alone tell not to open."""
    v = _last_volumes(spark, d).where(F.col("prior_month_quote_volume") >= 0)
    skipped = F.col("top") < F.col("floor")
    return planned(v, GROUP, "prior_month_quote_volume", "symbol", 10).agg(
        F.count("*").alias("row_groups"), F.count_if(skipped).alias("skipped"), F.sum("rows").alias("rows"), F.sum(F.when(skipped, F.col("rows")).otherwise(0)).alias("rows_skipped"))


def _top_ten(spark: SparkSession, d: str) -> DataFrame:
    v = _last_volumes(spark, d).where(F.col("prior_month_quote_volume") >= 0)
    return top_n(v, GROUP, "prior_month_quote_volume", "symbol", 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_ten(spark, d).select(*GROUP, "symbol", "rank_no")


def p3_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """The ten symbols of each group next to the counts on record."""
    counts = table(spark, d, "cohort_summary").withColumn("universe_month", _month("universe_month"))
    return _top_ten(spark, d).join(counts.select(*GROUP, "candidate_count", "eligible_count"), list(GROUP), "left")


def _panel_pairs(spark: SparkSession, d: str, join, **kw) -> DataFrame:
    return join(
        table(spark, d, "panel"), table(spark, d, "funding_events"), ("market", "symbol"), "panel_id", "btc_source_timestamp",
        "funding_id", "timestamp", "funding_rate", FIVE_MINUTES, **kw)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """By the streaming join, to which both tables are replayed in the order of event time."""
    return _panel_pairs(spark, d, nearest_replay).select(F.col("left_id").alias("panel_id"), F.col("right_id").alias("funding_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row that has a source time, with the funding rate nearest to it or none, in one batch job."""
    return _panel_pairs(spark, d, nearest_join, keep_unmatched=True).select(
        "market", "symbol", F.col("left_id").alias("panel_id"), F.col("right_id").alias("funding_id"), F.col("value").alias("funding_rate"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a window of at most 4,096 tokens."""
    return pack_documents(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the passages found within the edit budget those that hold twelve equal words in a row."""
    return _leaks(spark, d).where(F.col("exact") >= 12).select("item_id", "doc_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of twelve words of which up to one was changed, with where they end."""
    return _leaks(spark, d)


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every document's main language and every block written in another, with a confidence."""
    return label_languages(table(spark, d, "documents")).drop("said")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    labels = label_languages(table(spark, d, "documents"))
    wrong = (F.col("block_no") == -1) & (F.col("said").isNull() | (F.col("said") != F.col("lang_code")))
    return labels.where(F.col("lang_code").isNotNull() & (wrong | ((F.col("block_no") >= 0) & (F.col("words") >= 20)))).select(
        "doc_id", "block_no", "lang_code").distinct()


QUERIES = {f.__name__: f for f in (
    p3_found, p3_cohorts, p3_reads, p5_found, p5_rates, p8_windows, p9_found, p9_passages, p10_found, p10_labels)}

_RANKED = """
WITH months AS (SELECT *, CASE WHEN regexp_full_match(universe_month, '[0-9]{4}-[0-9]{2}(-[0-9]{2})?') THEN substr(universe_month, 1, 7) END AS m FROM monthly_volume),
newest AS (SELECT * FROM months QUALIFY row_number() OVER (PARTITION BY campaign_id, market, m, symbol ORDER BY recorded_at DESC) = 1),
ranked AS (SELECT campaign_id, market, m AS universe_month, symbol, prior_month_quote_volume,
  row_number() OVER (PARTITION BY campaign_id, market, m ORDER BY prior_month_quote_volume DESC, symbol) AS rank_no
  FROM newest WHERE prior_month_quote_volume >= 0 AND NOT isnan(prior_month_quote_volume) AND m IS NOT NULL QUALIFY rank_no <= 10)
"""
_PAIRED = """
WITH rows AS (SELECT DISTINCT panel_id, market, symbol, btc_source_timestamp AS t FROM panel WHERE btc_source_timestamp IS NOT NULL),
pairs AS (SELECT p.panel_id, e.funding_id, e.funding_rate FROM rows p JOIN funding_events e ON e.market = p.market AND e.symbol = p.symbol
  AND abs(epoch_us(e."timestamp") - epoch_us(p.t)) <= 300000000 AND e.funding_rate IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p.panel_id ORDER BY abs(epoch_us(e."timestamp") - epoch_us(p.t)), e."timestamp", e.funding_id) = 1)
"""
SQL = {
    "p3_found": _RANKED + "SELECT campaign_id, market, universe_month, symbol, rank_no FROM ranked",
    "p3_cohorts": _RANKED + """SELECT r.*, c.candidate_count, c.eligible_count FROM ranked r LEFT JOIN cohort_summary c
  ON c.campaign_id = r.campaign_id AND c.market = r.market AND substr(c.universe_month, 1, 7) = r.universe_month""",
    "p5_found": _PAIRED + "SELECT panel_id, funding_id FROM pairs",
    "p5_rates": _PAIRED + "SELECT r.market, r.symbol, r.panel_id, p.funding_id, p.funding_rate FROM rows r LEFT JOIN pairs p USING (panel_id)",
    "p9_found": r"""
WITH plain AS (SELECT doc_id AS id, TRUE AS is_doc, text FROM documents UNION ALL SELECT item_id, FALSE, text FROM eval_items),
words AS (SELECT id, is_doc, list_filter(string_split(regexp_replace(regexp_replace(replace(replace(replace(lower(text), '\\', ' '), '\-', ''), chr(173), ''), '\\[a-z@]+\*?', ' ', 'g'), '[^\p{L}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM plain),
runs AS (SELECT id, is_doc, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS run FROM words WHERE len(w) >= 12)
SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM runs i JOIN runs d ON i.run = d.run AND d.is_doc AND NOT i.is_doc""",
}
MODULES = [sys.modules[__name__]]
