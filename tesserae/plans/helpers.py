"""Queries that run parsers, period rules, rates and merges over tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions import columns
from tesserae.operators import fiscal, relational, valuation
from tesserae.sources import parsers, views
from tesserae.sources.views import table
from tesserae.streaming import ticks


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of equity and of capital, and years of advantage, of every customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    coe = valuation.cost_of_equity(F.lit(0.03), (k % 30).cast("double") / 16, F.lit(0.055))
    some = lambda every, x: F.when(k % every != 0, x)
    capital = valuation.wacc(coe, some(7, (k % 50).cast("double") * 10), some(5, F.col("c_acctbal")), some(11, (k % 9).cast("double") / 32), some(13, F.lit(0.05)))
    moat = F.when(k % 3 == 0, "strong").when(k % 3 == 1, "weak").otherwise("other")
    years = valuation.cap_years(some(6, (k % 40).cast("double") / 128), coe, moat)
    return c.select("c_custkey", F.round(coe, 8).alias("coe"), F.round(capital, 8).alias("wacc"), F.round(years, 6).alias("years"))


RATES = f"""WITH a AS (SELECT c_custkey, c_custkey AS k, 0.03::DOUBLE + (c_custkey % 30)::DOUBLE / 16 * 0.055::DOUBLE AS coe, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50)::DOUBLE * 10 END AS e, greatest(0, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, 0)) AS d,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 9)::DOUBLE / 32 END AS t, CASE WHEN c_custkey % 13 <> 0 THEN 0.05::DOUBLE END AS r, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 40)::DOUBLE / 128 END AS roe FROM customer)
SELECT c_custkey, round(coe, 8) AS coe, round(CASE WHEN e > 0 AND d > 0 AND t IS NOT NULL AND r IS NOT NULL THEN coe * e / (e + d) + r * (1 - t) * d / (e + d) ELSE coe END, 8) AS wacc,
  round(least({valuation.MAX_CAP}, CASE k % 3 WHEN 0 THEN {valuation.CAP_YEARS["strong"]} WHEN 1 THEN {valuation.CAP_YEARS["weak"]} ELSE {valuation.CAP_YEARS["medium"]} END * (0.5 + CASE WHEN roe IS NOT NULL THEN greatest(0, roe - coe) / (greatest(0, roe - coe) + coe) ELSE 0 END)), 1) AS years FROM a"""


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of orders as text, parsed again, with the day on which their quarter ends."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy.MM"), F.when(F.year("o_orderdate") > 1996, "(E)").otherwise("")).alias("period")).union(spark.createDataFrame([("1995",), ("later",)], "period string"))
    y, q, estimate = fiscal.period_parts(F.col("period"))
    return o.groupBy("period").agg(F.count("*").alias("n")).select("period", "n", y.alias("y"), q.alias("q"), estimate.alias("estimate"), fiscal.quarter_end(y, q).alias("ends"))


PERIODS = r"""WITH p AS (SELECT strftime(o_orderdate, '%Y.%m') || CASE WHEN year(o_orderdate) > 1996 THEN '(E)' ELSE '' END AS period, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q FROM orders UNION ALL SELECT '1995', NULL, NULL UNION ALL SELECT 'later', NULL, NULL)
SELECT period, count(*) AS n, y, q, contains(period, '(E)') AS estimate, CAST(last_day(make_date(y, q * 3, 1)) AS DATE) AS ends FROM p GROUP BY period, y, q"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of customers as a report prints them, read with the unit declared before, and checked for plausibility."""
    c = table(spark, sf_dir, "customer")
    k, whole = F.col("c_custkey"), F.round(F.abs("c_acctbal")).cast("long")
    shown = F.format_number(whole, 0)
    value = F.when(k % 9 == 0, "n/a").when(F.col("c_acctbal") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    declared = F.when(k % 20 == 0, "(단위 : 백만원)").when(k % 20 == 10, "단위: 천원")
    rows = c.select((k % 10).alias("doc"), k.alias("n"), F.concat(F.lit(" 1. Cash (note "), k.cast("string"), F.lit(")")).alias("label"), value.alias("value"), F.coalesce(declared, F.lit("")).alias("text"))
    out = parsers.cells(rows)
    return out.withColumn("plausible", parsers.plausible(F.col("amount"), F.lit(1e8))).groupBy("doc", "label").agg(F.count("amount").alias("read"), F.count("plausible").alias("plausible"), F.sum(F.col("amount").cast("decimal(30,2)")).cast("double").alias("total"))


NUMBERS = """WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS doc, CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal)) * CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END END AS v, CASE WHEN c_custkey % 20 = 0 THEN 1000000 WHEN c_custkey % 20 = 10 THEN 1000 END AS u FROM customer),
f AS (SELECT *, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k), 1) AS factor FROM c)
SELECT doc, 'cash' AS label, count(v) AS read, count(*) FILTER (abs(v * factor) <= 8e8) AS plausible, CAST(sum(CAST(v * factor AS DECIMAL(30, 2))) AS DOUBLE) AS total FROM f GROUP BY 1"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's field from its items: by id, else by name; JSON found in prose beside it."""
    p = table(spark, sf_dir, "part")
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    item = lambda i, n, v: F.struct(F.lit(i).alias("account_id"), F.lit(n).alias("name"), v.alias("amount"))
    held = F.array(item("x_other", "Other", price * 0 + 1), F.when(k % 2 == 0, item("ifrs_Revenue", "anything", price)).otherwise(item("x_9", "II. Sales (note 4)", price * 2)))
    prose = F.concat(F.lit("The answer: {\"score\": "), (k % 7).cast("string"), F.when(k % 5 == 0, "").otherwise("}"), F.lit(" so much."))
    parsed = parsers.json_in_text(prose, "score int")
    return p.select("p_partkey", parsers.statement_field(held, ["ifrs_Revenue", "dart_Sales"], ["Sales"]).alias("revenue"), parsed["score"].alias("score"))


ITEMS = "SELECT p_partkey, p_retailprice * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS revenue, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 7 AS INT) END AS score FROM part"


def monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least open order of each customer, kept as batches of years come, and the share of names that are alike."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("low"))
    old, new = (o.where(f"y {op} 1996").groupBy("o_custkey").agg(F.min("low").alias(name)) for op, name in (("<=", "old"), (">", "new")))
    return old.join(new, "o_custkey", "full").select("o_custkey", relational.monotone_least(F.col("old"), F.col("new")).alias("low"))


MONOTONE = """WITH o AS (SELECT o_custkey, min(o_totalprice) FILTER (o_orderstatus = 'O' AND year(o_orderdate) <= 1996) AS old, min(o_totalprice) FILTER (o_orderstatus = 'O' AND year(o_orderdate) > 1996) AS new FROM orders GROUP BY 1) SELECT o_custkey, least(old, new) AS low FROM o"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the key that tells repeats: the first of each, and how many came."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 5).cast("int")).alias("day"), F.coalesce("text", F.lit("")).alias("body"))
    keyed = c.withColumn("key", ticks.dedup_key("kind", "day", "body"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "turn")).alias("f")).select("key", "n", F.col("f.conv_id").alias("conv_id"), F.col("f.turn").alias("turn"))


KEYS = """WITH c AS (SELECT conv_id, turn, concat_ws('|', coalesce(role, ''), CAST(CAST(DATE '2024-01-01' + CAST(conv_id % 5 AS INT) AS DATE) AS VARCHAR), left(sha256(coalesce(text, '')), 12)) AS key FROM conversations)
SELECT key, count(*) AS n, first(conv_id ORDER BY conv_id, turn) AS conv_id, first(turn ORDER BY conv_id, turn) AS turn FROM c GROUP BY 1"""


def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next part's, as sets of words, and whether it begins a new run of brands."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(" (x)")).alias("name")).withColumn("next", F.lead("name").over(w))
    return p.select("p_partkey", F.round(columns.token_jaccard(F.col("name"), F.col("next")), 6).alias("alike"))


ALIKE_NAMES = """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' x'), ' ')) AS a, lead(list_distinct(string_split(lower(p_name || ' x'), ' '))) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, CASE WHEN b IS NOT NULL THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS alike FROM p"""


QUERIES = {
    "f32_f33_periods": periods,
    "f34_f38_numbers": numbers,
    "f37_f39_items": items,
    "t5_monotone": monotone,
    "f40_keys": keys,
    "f45_alike_names": alike_names,
    "f19_f20_rates": rates,
}
ORACLES = {
    "f32_f33_periods": PERIODS,
    "f34_f38_numbers": NUMBERS,
    "f37_f39_items": ITEMS,
    "t5_monotone": MONOTONE,
    "f40_keys": KEYS,
    "f45_alike_names": ALIKE_NAMES,
    "f19_f20_rates": RATES,
}
