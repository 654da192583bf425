"""Queries over sequential kernels, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import prices, sequences
from tesserae.plans import waves
from tesserae.sources import parsers, views
from tesserae.sources.views import table
from tesserae.streaming import ticks


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.zigzag(views.bars(spark, sf_dir))


def impulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.impulses(zigzag(spark, sf_dir)).withColumn("score", F.round("score", 6))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.corrections(zigzag(spark, sf_dir)).withColumn("score", F.round("score", 6))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.cycles(zigzag(spark, sf_dir))


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivots = zigzag(spark, sf_dir)
    return sequences.projections(pivots, sequences.cycles(pivots), views.bars(spark, sf_dir))


def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.swings(zigzag(spark, sf_dir))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.boxes(zigzag(spark, sf_dir), views.bars(spark, sf_dir))


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.structure(zigzag(spark, sf_dir))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of stages in day bars."""
    return sequences.segments(prices.staged(views.bars(spark, sf_dir), "short").select("code", "bar_date", "close", "stage", "side", "slope"), prices.FRAMES["short"][3], in_order=True)


def trend_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage of each code in three frames, its place to the long average and its rating."""
    bars = views.bars(spark, sf_dir)
    out = prices.strength_ratings(bars).select("code", "rating").join(prices.last_stages(bars), "code", "left")
    return out.join(secular(spark, sf_dir).select("code", "position", "heading"), "code", "left")


def secular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.secular(prices.resample(views.bars(spark, sf_dir), "month").select("code", F.col("bar_date").alias("month"), "close"))


SECULAR = f"""WITH {views.BARS}, m AS (SELECT code, max(bar_date) AS month, last(close ORDER BY bar_date) AS close FROM bars GROUP BY code, date_trunc('month', bar_date)),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY month DESC) AS k, greatest(40, least(120, count(*) OVER (PARTITION BY code) - 12)) AS size, count(*) OVER (PARTITION BY code) AS n FROM m),
g AS (SELECT code, CAST(any_value(size) AS INT) AS months, avg(close) FILTER (k <= size) AS now, avg(close) FILTER (k > 12 AND k <= size + 12) AS before, max(close) FILTER (k = 1) AS last FROM k WHERE n >= 52 GROUP BY 1)
SELECT code, months, CASE WHEN last / now - 1 > 0.03 THEN 'above' WHEN last / now - 1 < -0.03 THEN 'below' ELSE 'near' END AS position, CASE WHEN now / before - 1 > 0.02 THEN 'rising' WHEN now / before - 1 < -0.02 THEN 'falling' ELSE 'flat' END AS heading, round(last / now - 1, 4) + 0.0 AS ratio FROM g"""


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.page_list(table(spark, sf_dir, "pages")).select("page_id", "lang", "links", "paragraphs")


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ticks.run_to_table(ticks.bars(ticks.read_table(spark, sf_dir, "events")), ["w", "event_type"], "bars")
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "open", "high", "low", "close", "n")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ticks.run_to_table(ticks.latest(ticks.read_table(spark, sf_dir, "events")), ["user_id"], "latest")
    return out.select("user_id", "t.event_id", "t.event_type", "t.value")


QUERIES = {
    "w23_zigzag": zigzag,
    "w24_impulses": impulses,
    "w25_corrections": corrections,
    "w26_cycles": cycles,
    "w27_projections": projections,
    "w28_swings": swings,
    "w28_structure": structure,
    "w29_boxes": boxes,
    "w21_segments": segments,
    "w22_secular": secular,
    "w30_trend_frames": trend_frames,
    "s5_page_list": page_list,
    "t15_stream_bars": stream_bars,
    "t13_stream_latest": stream_latest,
}

ORACLES = {
    **waves.ORACLES,
    "w22_secular": SECULAR,
    "s5_page_list": """SELECT page_id, regexp_extract(html, '<html[^>]*\\blang="([a-zA-Z-]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INTEGER) AS paragraphs FROM pages""",
    "t15_stream_bars": "SELECT event_type, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "t13_stream_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
