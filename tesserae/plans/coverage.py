"""Queries over what is written of companies: coverage by mention, sentiment of industries, the newest of each feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators import mentions
from tesserae.operators.relational import sentiment_value
from tesserae.plans.graphs import MENTIONED_NAMES, supplier_names, texts_of
from tesserae.sources import views
from tesserae.sources.views import REPORTS, table

SINCE = "2024-02-01"
_SENTIMENT = "CASE sentiment WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END"


def covered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """code, group (of codes with equal names); and group with the reports that name it, so that what its codes have in common is counted once."""
    codes, found = mentions.grouped(texts_of(spark, sf_dir), supplier_names(spark, sf_dir))
    return codes, found.withColumnRenamed("t_id", "doc_id").join(views.reports(spark, sf_dir), "doc_id")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that name each company since a day, those that say buy, the newest of them and its industry; companies without any count none."""
    companies, named = covered(spark, sf_dir)
    got = named.where(F.col("day") >= F.lit(SINCE).cast("date")).groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "BUY").alias("buys"), F.max_by(F.struct("doc_id", "industry"), F.struct("day", "doc_id")).alias("top"))
    codes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    return codes.join(companies.join(got, "group"), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("reports"), F.coalesce("buys", F.lit(0)).alias("buys"), F.col("top.doc_id").alias("newest"), F.col("top.industry").alias("industry"))


_NAMED = MENTIONED_NAMES.replace("WITH n AS", "n AS", 1)
_MENTIONED = f"m AS (WITH {_NAMED})"
COVERAGE = f"""WITH {REPORTS}, {_MENTIONED}, c AS (SELECT code, count(*) AS n, count(*) FILTER (sentiment = 'BUY') AS buys, arg_max(doc_id, (day, doc_id)) AS newest, arg_max(industry, (day, doc_id)) AS industry FROM m JOIN reports ON t_id = doc_id WHERE day >= DATE '{SINCE}' GROUP BY 1)
SELECT s_suppkey AS code, coalesce(n, 0) AS reports, coalesce(buys, 0) AS buys, newest, industry FROM supplier LEFT JOIN c ON code = s_suppkey"""


def industry_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentiment of each industry's days, and of the week up to each."""
    r = views.reports(spark, sf_dir).groupBy("industry", "day").agg(F.sum(sentiment_value(F.col("sentiment"))).alias("s"), F.count("*").alias("n"))
    week = Window.partitionBy("industry").orderBy(F.datediff("day", F.lit("2024-01-01").cast("date"))).rangeBetween(-6, 0)  # a row for each day
    return r.select("industry", "day", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.sum("s").over(week) / F.sum("n").over(week), 6).alias("week"))


INDUSTRY_SERIES = f"""WITH {REPORTS}, d AS (SELECT industry, day, sum({_SENTIMENT}) AS s, count(*) AS n FROM reports GROUP BY 1, 2)
SELECT industry, day, n, round(s / n, 6) + 0.0 AS mean, round(sum(s) OVER w / sum(n) OVER w, 6) + 0.0 AS week FROM d WINDOW w AS (PARTITION BY industry ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"""


def industry_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies that an industry's reports name: in how many, and how they are seen there beside the industry's mean."""
    every = views.reports(spark, sf_dir).groupBy("industry").agg(F.avg(sentiment_value(F.col("sentiment"))).alias("whole"))
    companies, named = covered(spark, sf_dir)
    each = named.groupBy("industry", "group").agg(F.count("*").alias("n"), F.avg(sentiment_value(F.col("sentiment"))).alias("mean")).join(companies, "group")
    return each.join(F.broadcast(every), "industry").select("industry", "code", "n", F.round(F.col("mean") - F.col("whole"), 6).alias("above"))  # a row for each industry


INDUSTRY_COMPANIES = f"""WITH {REPORTS}, {_MENTIONED}, w AS (SELECT industry, avg({_SENTIMENT}) AS whole FROM reports GROUP BY 1), e AS (SELECT industry, code, count(*) AS n, avg({_SENTIMENT}) AS mean FROM m JOIN reports ON t_id = doc_id GROUP BY 1, 2)
SELECT industry, code, n, round(mean - whole, 6) + 0.0 AS above FROM e JOIN w USING (industry)"""


def todays_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of the newest day of each market, the most read first."""
    r = views.reports(spark, sf_dir)
    newest = r.groupBy("market").agg(F.max("day").alias("day"))
    order = Window.partitionBy("market").orderBy(F.desc("views"), "doc_id")  # one day's reports
    return r.join(F.broadcast(newest), ["market", "day"]).select("market", "day", "doc_id", "sentiment", F.row_number().over(order).alias("place"))


TODAYS_REPORTS = f"""WITH {REPORTS}, n AS (SELECT market, max(day) AS day FROM reports GROUP BY 1)
SELECT market, day, doc_id, sentiment, CAST(row_number() OVER (PARTITION BY market ORDER BY views DESC, doc_id) AS INTEGER) AS place FROM reports JOIN n USING (market, day)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each kind of event: how many, the days until the next one, and whether they are still to come on the 15th."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("most"))
    w = Window.partitionBy("event_type").orderBy("day")  # a row for each day
    return e.select("event_type", "day", "n", "most", F.datediff(F.lead("day").over(w), "day").alias("until_next"), (F.col("day") > F.lit("2024-01-15").cast("date")).alias("to_come"))


CALENDAR = """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2)
SELECT event_type, day, n, most, CAST(lead(day) OVER (PARTITION BY event_type ORDER BY day) - day AS INTEGER) AS until_next, day > DATE '2024-01-15' AS to_come FROM e"""

QUERIES = {"q12_coverage_by_name": coverage, "q13_industry_series": industry_series, "q13_industry_companies": industry_companies, "q19_todays_reports": todays_reports, "q19_calendar": calendar}
ORACLES = {"q12_coverage_by_name": COVERAGE, "q13_industry_series": INDUSTRY_SERIES, "q13_industry_companies": INDUSTRY_COMPANIES, "q19_todays_reports": TODAYS_REPORTS, "q19_calendar": CALENDAR}
