"""Views of the driver's tables in the shapes that the queries work on, and their SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import barstore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars of each supplier, from the stored table: code, bar_date, open, high, low, close, volume."""
    stored = barstore.table_of(derived_bars(spark, sf_dir), "day", "bar_date", barstore.made_from(spark, f"{sf_dir}/lineitem.parquet"))
    return stored.drop("year")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of each user's events, from the stored table: code, bar_ts, open, high, low, close, n, day."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select(F.col("user_id").alias("code"), "value", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("bar_ts"), F.struct("ts", "event_id").alias("o"))
    made = barstore.dealt(e).groupBy("code", "bar_ts").agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").alias("n"))
    return barstore.table_of(made, "minute", "bar_ts", barstore.made_from(spark, f"{sf_dir}/events.parquet"))


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars out of single trades."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("bar_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", order.alias("o")
    )
    return barstore.dealt(lines).groupBy("code", "bar_date").agg(  # trades of one code and day are few: the only exchange is by code
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume")
    )


BARS = """bars AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS bar_date,
         first(p ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""


def benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all suppliers: bar_date, level."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("bar_date"), "l_extendedprice", "l_quantity")
    return lines.groupBy("bar_date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("level"))


INDEX = """idx AS (
  SELECT CAST(l_shipdate AS DATE) AS bar_date, sum(l_extendedprice) / sum(l_quantity) AS level FROM lineitem GROUP BY 1)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with market (region) and sector (nation)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
        .select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("market"), F.col("s_acctbal").alias("cap"))
    )


UNIVERSE = """universe AS (
  SELECT s_suppkey AS code, s_name AS name, n_name AS sector, r_name AS market, s_acctbal AS cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an opinion: doc_id, industry, market, views, day, sentiment."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    opinion = F.when(F.col("toxic") == 1, "SELL").when(F.col("quality") == 1, "BUY").otherwise("HOLD")
    return d.join(l, "doc_id").select("doc_id", F.col("source").alias("industry"), F.col("lang").alias("market"), F.col("n_chars").alias("views"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 180).cast("int")).alias("day"), opinion.alias("sentiment"))


REPORTS = """reports AS (
  SELECT doc_id, source AS industry, lang AS market, n_chars AS views,
         CAST(DATE '2024-01-01' + CAST(doc_id % 180 AS INTEGER) AS DATE) AS day,
         CASE WHEN toxic = 1 THEN 'SELL' WHEN quality = 1 THEN 'BUY' ELSE 'HOLD' END AS sentiment
  FROM documents JOIN labels USING (doc_id))"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal quarters of each customer nation: code, y, q, revenue, profit, lines.

    Amounts are summed as decimals: a sum of doubles depends on the order of its rows, and so would a rounded tie.
    """
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    price, off, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    lines = l.select("l_orderkey", price.alias("price"), (price * (off - tax)).alias("profit"))
    sold = lines.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(
        F.sum("price").cast("double").alias("revenue"), F.round(F.sum("profit"), 2).cast("double").alias("profit"), F.count("*").alias("lines")
    )


QUARTERS = """quarters AS (
  SELECT c_nationkey AS code, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS revenue,
         CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (CAST(l_discount AS DECIMAL(4, 2)) - CAST(l_tax AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS profit, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part edges with the supplier's revenue share: src, dst, revenue, share."""
    from pyspark.sql import Window

    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_extendedprice").alias("revenue"))
    return sold.withColumn("share", F.col("revenue") / F.sum("revenue").over(Window.partitionBy("src")) * 100)


EDGES = """edges AS (
  SELECT *, revenue / sum(revenue) OVER (PARTITION BY src) * 100 AS share
  FROM (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1, 2))"""
