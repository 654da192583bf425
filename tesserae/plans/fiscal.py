"""Queries over fiscal series, ratios and valuations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import fiscal, ratios, valuation
from tesserae.sources import barstore, views
from tesserae.sources.views import QUARTERS, table

_N = "y * 4 + q - 1"


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.growth(views.quarters(spark, sf_dir))


GROWTH = f"""WITH {QUARTERS}, n AS (SELECT *, {_N} AS n FROM quarters),
j AS (SELECT a.*, b.revenue AS r0, b.profit AS p0, c.revenue AS rq FROM n a LEFT JOIN n b ON a.code = b.code AND b.n = a.n - 4 LEFT JOIN n c ON a.code = c.code AND c.n = a.n - 1)
SELECT code, y, q, CASE WHEN r0 > 0 THEN round((revenue - r0) / r0, 4) + 0.0 END AS revenue_yoy, CASE WHEN rq > 0 THEN round((revenue - rq) / rq, 4) + 0.0 END AS revenue_qoq,
  CASE WHEN p0 > 0 THEN round((profit - p0) / p0, 4) + 0.0 END AS profit_yoy,
  CASE WHEN p0 IS NULL THEN NULL WHEN profit > 0 AND p0 > 0 THEN 'profit' WHEN profit > 0 THEN 'turnaround' WHEN p0 > 0 THEN 'deficit' ELSE 'loss' END AS status,
  CASE WHEN r0 > 0 AND revenue > 0 THEN round(profit / revenue - p0 / r0, 4) + 0.0 END AS margin_delta FROM j"""


def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quarters(spark, sf_dir)
    out = fiscal.trailing(fiscal.trailing(q, "revenue", "revenue_ttm"), "profit", "profit_ttm")
    return out.select("code", "y", "q", F.round("revenue_ttm", 2).alias("revenue_ttm"), F.round("profit_ttm", 2).alias("profit_ttm"))


TTM = f"""WITH {QUARTERS}, n AS (SELECT *, {_N} AS n FROM quarters)
SELECT code, y, q, CASE WHEN count(revenue) OVER w = 4 THEN round(sum(revenue) OVER w, 2) END AS revenue_ttm, CASE WHEN count(profit) OVER w = 4 THEN round(sum(profit) OVER w, 2) END AS profit_ttm
FROM n WINDOW w AS (PARTITION BY code ORDER BY n RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"""


def discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters whose fourth holds the year, taken apart again."""
    from pyspark.sql import Window

    q = views.quarters(spark, sf_dir)
    year = F.sum("lines").over(Window.partitionBy("code", "y"))
    cumulative = q.withColumn("lines", F.when(F.col("q") == 4, year).otherwise(F.col("lines")).cast("double"))
    return fiscal.discrete(cumulative, "lines").select("code", "y", "q", "lines")


DISCRETE = f"WITH {QUARTERS} SELECT code, y, q, CASE WHEN q < 4 OR count(*) FILTER (q < 4) OVER (PARTITION BY code, y) = 3 THEN CAST(lines AS DOUBLE) END AS lines FROM quarters"


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.incremental_margin(views.quarters(spark, sf_dir), "revenue", "profit").withColumn("margin", F.round("margin", 6))


MARGIN = f"""WITH {QUARTERS}, n AS (SELECT *, {_N} AS n FROM quarters), d AS (SELECT a.code, a.revenue - b.revenue AS dr, a.profit - b.profit AS dp FROM n a JOIN n b ON a.code = b.code AND b.n = a.n - 4)
SELECT code, count(*) AS n, round(sum(dp) / sum(dr), 6) AS margin FROM d WHERE dr > 0 GROUP BY 1 HAVING count(*) >= 4"""


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.growth_ensemble(views.quarters(spark, sf_dir), "revenue").withColumn("growth", F.round("growth", 6))


ENSEMBLE = f"""WITH {QUARTERS}, n AS (SELECT *, {_N} AS n FROM quarters),
g AS (SELECT a.code, a.revenue / b.revenue - 1 AS g, row_number() OVER (PARTITION BY a.code ORDER BY a.n DESC) AS k FROM n a JOIN n b ON a.code = b.code AND b.n = a.n - 4 WHERE b.revenue > 0),
l AS (SELECT code, count(*) AS n, avg(g) AS m, max(g) FILTER (k = 1) AS g1, max(g) FILTER (k = 2) AS g2, max(g) FILTER (k = 3) AS g3 FROM g WHERE k <= 12 GROUP BY 1)
SELECT code, n, round(0.4::DOUBLE * m + 0.3::DOUBLE * g1 + 0.3::DOUBLE * (g1 + (g1 - g2) + 0.5::DOUBLE * (g1 - 2 * g2 + g3)), 6) AS growth FROM l WHERE n >= 3"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters and years as dated spans: every third code reports four quarters, the others three and the year; some quarters twice."""
    q = views.quarters(spark, sf_dir)
    one = q.where("q < 4 or code % 3 = 0").select("code", F.make_date("y", F.col("q") * 3 - 2, F.lit(1)).alias("start"), fiscal.quarter_end(F.col("y"), F.col("q")).alias("end"), F.col("lines").cast("double").alias("val"), F.lit(1).alias("ord"))
    again = one.where("month(end) = 6 and code % 4 = 0").withColumns({"val": F.col("val") + 1, "ord": F.lit(2)})
    years = q.where("code % 3 <> 0").groupBy("code", "y").agg(F.sum("lines").cast("double").alias("val"), F.count("*").alias("n")).where("n = 4")
    return one.unionByName(again).unionByName(years.select("code", F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"), "val", F.lit(1).alias("ord")))


SPANS = f"""{QUARTERS}, spans AS (
  SELECT code, make_date(y, q * 3 - 2, 1) AS s, last_day(make_date(y, q * 3, 1)) AS e, lines::DOUBLE + CASE WHEN q = 2 AND code % 4 = 0 THEN 1 ELSE 0 END AS val FROM quarters WHERE q < 4 OR code % 3 = 0
  UNION ALL SELECT code, make_date(y, 1, 1), make_date(y, 12, 31), sum(lines)::DOUBLE FROM quarters WHERE code % 3 <> 0 GROUP BY code, y HAVING count(*) = 4),
qs AS (SELECT * FROM spans WHERE e - s BETWEEN 80 AND 100), fy AS (SELECT code, max(e) AS fe, arg_max(val, e) AS fv FROM spans WHERE e - s BETWEEN 350 AND 380 GROUP BY 1),
aft AS (SELECT q.code, q.val, (SELECT min(o.val) FROM qs o WHERE o.code = q.code AND abs(o.e - (q.e - 365)) <= 20) AS old FROM qs q JOIN fy ON q.code = fy.code WHERE q.e > fe),
newest AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY e DESC) AS k FROM qs WHERE code NOT IN (SELECT code FROM fy)),
span_ttm AS (SELECT code, CASE WHEN count(*) FILTER (p AND old IS NULL) = 0 THEN any_value(fv) + coalesce(sum(val - old), 0) END AS ttm FROM (SELECT fy.code, fv, val, old, aft.code IS NOT NULL AS p FROM fy LEFT JOIN aft ON fy.code = aft.code) GROUP BY 1
  UNION ALL SELECT code, CASE WHEN count(*) = 4 AND max(e) - min(s) BETWEEN 350 AND 380 THEN sum(val) END FROM newest WHERE k <= 4 GROUP BY 1)"""


def span_ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.spans_ttm(_spans(spark, sf_dir))


SPAN_TTM = f"WITH {SPANS} SELECT code, ttm FROM span_ttm"

#: Concepts of one quantity in order of preference, and what they are called here.
REVENUE_CONCEPTS = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"]
CONCEPTS = {"Revenues": "revenue", "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue", "SalesRevenueNet": "revenue", "StockholdersEquity": "equity", "EntityCommonStockSharesOutstanding": "shares"}


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each code, as a registry serves them: two revenue concepts, one of them out of use for even codes, and values at a day."""
    spans = _spans(spark, sf_dir)
    row = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val")
    listed = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("ord", row.alias("r"))))), lambda x: x["r"])
    at = F.transform(F.sort_array(F.collect_list(F.when(F.month("end") != 9, F.struct("ord", F.struct(F.lit(None).cast("string").alias("start"), F.col("end").cast("string").alias("end"), (F.col("val") * 3).alias("val")).alias("r"))))), lambda x: x["r"])
    per = spans.groupBy("code").agg(listed(F.lit(True)).alias("now"), listed(F.year("end") < 1995).alias("old"), at.alias("equity"))
    concept = lambda label, unit, rows: F.struct(F.lit(label).alias("label"), F.create_map(F.lit(unit), rows).alias("units"))
    first = F.when(F.col("code") % 2 == 0, F.col("old")).otherwise(F.col("now"))
    gaap = F.create_map(F.lit("Revenues"), concept("Revenues", "USD", first), F.lit("SalesRevenueNet"), concept(None, "USD", F.col("now")), F.lit("StockholdersEquity"), concept("Equity", "USD", F.col("equity")), F.lit("Unknown"), concept("?", "USD", F.col("old")))
    dei = F.create_map(F.lit("EntityCommonStockSharesOutstanding"), concept("Shares", "shares", F.slice("equity", 1, 5)))
    return per.select("code", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), gaap, F.lit("dei"), dei).alias("facts"))).alias("doc"))


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From nested documents: which concept is in use, its trailing twelve months, the latest equity, and their ratio."""
    facts = fiscal.flatten_facts(_filings(spark, sf_dir))
    chosen = fiscal.newest_concept(facts, REVENUE_CONCEPTS)
    ttm = fiscal.spans_ttm(facts.join(chosen, ["code", "concept"], "left_semi").select("code", "start", "end", "val", "ord"))
    out = chosen.join(ttm, "code", "left").join(fiscal.latest_instant(facts, "StockholdersEquity", "equity"), "code", "left")
    return out.select("code", "concept", "ttm", "equity", F.round(F.try_divide("ttm", F.when(F.col("equity") > 0, F.col("equity"))), 6).alias("turnover"))


COMPANY_FACTS = f"""WITH {SPANS}, n AS (SELECT code, max(e) AS e, max(e) FILTER (year(e) < 1995) AS old FROM spans GROUP BY 1),
q AS (SELECT code, arg_max(val - CASE WHEN month(e) = 6 AND code % 4 = 0 THEN 1 ELSE 0 END, e) * 3 AS equity FROM spans WHERE month(e) <> 9 GROUP BY 1)
SELECT n.code, CASE WHEN n.code % 2 = 1 OR n.old = n.e THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, ttm, equity, round(ttm / CASE WHEN equity > 0 THEN equity END, 6) AS turnover
FROM n LEFT JOIN span_ttm t ON t.code = n.code LEFT JOIN q ON q.code = n.code"""


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts under the names of the ontology: how many of each, and their sum."""
    names = F.create_map(*[F.lit(x) for kv in CONCEPTS.items() for x in kv])
    facts = fiscal.flatten_facts(_filings(spark, sf_dir)).withColumn("id", F.try_element_at(names, F.col("concept"))).where("id is not null")
    return facts.groupBy("code", "id", "namespace", "unit").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"))


KNOWN_FACTS = f"""WITH {QUARTERS}, raw AS (
  SELECT code, 1 AS ord, last_day(make_date(y, q * 3, 1)) AS e, lines::DOUBLE AS val FROM quarters WHERE q < 4 OR code % 3 = 0
  UNION ALL SELECT code, 2, last_day(make_date(y, 6, 1)), lines + 1 FROM quarters WHERE q = 2 AND code % 4 = 0
  UNION ALL SELECT code, 1, make_date(y, 12, 31), sum(lines) FROM quarters WHERE code % 3 <> 0 GROUP BY code, y HAVING count(*) = 4),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord, e, val) AS k FROM raw WHERE month(e) <> 9),
f AS (SELECT code, 'revenue' AS id, 'us-gaap' AS namespace, 'USD' AS unit, val FROM raw UNION ALL SELECT code, 'revenue', 'us-gaap', 'USD', val FROM raw WHERE code % 2 = 1 OR year(e) < 1995
  UNION ALL SELECT code, 'equity', 'us-gaap', 'USD', val * 3 FROM k UNION ALL SELECT code, 'shares', 'dei', 'shares', val * 3 FROM k WHERE k <= 5)
SELECT code, id, namespace, unit, count(*) AS n, round(sum(val), 2) AS total FROM f GROUP BY ALL"""


def rolling_and_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-row sums, the mean of the last five quarters, and profit at the margin of the middle of the cycle."""
    q = views.quarters(spark, sf_dir)
    last = fiscal.rolling_rows(q, "revenue", "sum4").groupBy("code").agg(F.round(F.max_by("sum4", fiscal.number()), 2).alias("sum4"))
    norm = fiscal.normalized_profit(q.withColumn("earned", F.abs("profit")), "revenue", "earned", "earned")
    return last.join(fiscal.recent_mean(q, "profit", 5).withColumnRenamed("n", "quarters"), "code").join(norm, "code").select("code", "sum4", "mean", "quarters", "windows", F.round("normalized", 4).alias("normalized"))


ROLLING = f"""WITH {QUARTERS}, n AS (SELECT *, {_N} AS n, row_number() OVER (PARTITION BY code ORDER BY {_N} DESC) AS k FROM quarters),
w AS (SELECT *, CASE WHEN count(*) OVER f = 4 THEN sum(revenue) OVER f END AS r4, CASE WHEN count(*) OVER f = 4 THEN sum(abs(profit)) OVER f END AS p4 FROM n WINDOW f AS (PARTITION BY code ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
m AS (SELECT code, list_sort(list(p4 / r4)) AS a, arg_max(p4 / r4, n) AS today, arg_max(abs(profit), n) AS now, count(*) AS windows FROM w WHERE r4 > 0 GROUP BY 1)
SELECT w.code, round(arg_max(r4, n), 2) AS sum4, round(avg(profit) FILTER (k <= 5), 4) AS mean, count(*) FILTER (k <= 5) AS quarters, any_value(windows) AS windows,
  round(any_value(CASE WHEN windows >= 6 AND today > 0 AND a[CAST(floor(windows / 2) AS INT) + 1] > 0 THEN now * a[CAST(floor(windows / 2) AS INT) + 1] / today END), 4) AS normalized FROM w JOIN m ON w.code = m.code GROUP BY 1"""


def long_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fiscal.long_growth(views.quarters(spark, sf_dir), "revenue")
    return got.select("code", *[F.round(c, 6).alias(c) for c in ("cagr", "blended", "sustainable")])


LONG_GROWTH = f"""{ENSEMBLE.replace("round(0.4", "(0.4").replace(", 6) AS growth FROM l WHERE n >= 3", ") AS growth FROM l WHERE n >= 3")}"""
LONG_GROWTH = f"""WITH e AS ({LONG_GROWTH}), {QUARTERS}, c AS (SELECT code, arg_min(revenue, {_N}) AS a, arg_max(revenue, {_N}) AS b, count(*) AS n FROM quarters GROUP BY 1),
r AS (SELECT code, CASE WHEN n > 4 AND a > 0 AND b > 0 THEN pow(b / a, 4 / (n - 1)) - 1 END AS cagr FROM c)
SELECT code, round(cagr, 6) AS cagr, round(CASE WHEN cagr IS NOT NULL THEN 0.5 * growth + 0.5 * cagr ELSE growth * 0.5 END, 6) AS blended, round(coalesce(cagr, growth * 0.5), 6) AS sustainable FROM r LEFT JOIN e USING (code)"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and margin change of each code's last whole year."""
    y = views.quarters(spark, sf_dir).groupBy("code", "y").agg(F.round(F.sum("profit"), 2).alias("profit"), F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n")).where("n = 4")
    return fiscal.annual_change(y, "profit", "revenue")


ANNUAL = f"""WITH {QUARTERS}, y AS (SELECT code, y, round(sum(profit), 2) AS p, round(sum(revenue), 2) AS r FROM quarters GROUP BY 1, 2 HAVING count(*) = 4),
l AS (SELECT *, lag(y) OVER w AS y0, lag(p) OVER w AS p0, lag(r) OVER w AS r0, row_number() OVER (PARTITION BY code ORDER BY y DESC) AS k FROM y WINDOW w AS (PARTITION BY code ORDER BY y))
SELECT code, y, CASE WHEN p > 0 AND p0 > 0 THEN 'profit' WHEN p > 0 THEN 'turnaround' WHEN p0 > 0 THEN 'deficit' ELSE 'loss' END AS status, round(CASE WHEN r > 0 THEN p / r END - CASE WHEN r0 > 0 THEN p0 / r0 END, 4) + 0.0 AS margin_delta FROM l WHERE k = 1 AND y - y0 = 1"""


def rates_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every month with orders of a priority the rate of the last month before that has one, up to a year back; two months of three have none."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    per = o.groupBy(F.col("o_orderpriority").alias("code"), month.alias("month")).agg(F.count("*").alias("rate")).withColumn("rate", F.when(F.col("rate") % 3 == 1, F.col("rate")))
    return per.withColumn("before", fiscal.month_before(per, "rate"))


RATES_BEFORE = """WITH p AS (SELECT o_orderpriority AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month, CASE WHEN count(*) % 3 = 1 THEN count(*) END AS rate FROM orders GROUP BY 1, 2)
SELECT *, last_value(rate IGNORE NULLS) OVER (PARTITION BY code ORDER BY month RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before FROM p"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples of every quarter: the last close up to its end times shares, over trailing revenue and profit, or the year's where quarters lack."""
    q = fiscal.trailing(fiscal.trailing(views.quarters(spark, sf_dir).withColumn("earned", F.abs("profit")), "revenue", "r"), "earned", "e")
    from pyspark.sql import Window

    year = Window.partitionBy("code", "y")
    q = q.withColumn("r", F.coalesce("r", F.when(F.count("*").over(year) == 4, F.sum("revenue").over(year)))).withColumn("quarter_end", fiscal.quarter_end(F.col("y"), F.col("q")))
    closes = views.bars(spark, sf_dir).select("code", "bar_date", "close")
    # an as-of join as a union and one window
    both = q.select("code", F.col("quarter_end").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("close"), "y", "q", "r", "e")
    both = both.unionByName(closes.join(q.select("code").distinct(), "code", "left_semi").select("code", F.col("bar_date").alias("day"), F.lit(0).alias("kind"), "close"), allowMissingColumns=True)
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("code").orderBy("day", "kind"))
    cap = F.col("last") * 1000
    ratio = lambda c: F.round(F.when(F.col(c) > 0, cap / F.col(c)), 4)
    return both.withColumn("last", last).where("kind = 1").select("code", "y", "q", ratio("e").alias("per"), ratio("r").alias("psr"))


HISTORY = f"""WITH {QUARTERS}, {views.BARS}, n AS (SELECT *, {_N} AS n, last_day(make_date(y, q * 3, 1)) AS d FROM quarters),
t AS (SELECT code, y, q, d, CASE WHEN count(*) OVER w = 4 THEN sum(revenue) OVER w WHEN count(*) OVER z = 4 THEN sum(revenue) OVER z END AS r, CASE WHEN count(*) OVER w = 4 THEN sum(abs(profit)) OVER w END AS e
  FROM n WINDOW w AS (PARTITION BY code ORDER BY n RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), z AS (PARTITION BY code, y))
SELECT t.code, y, q, round(CASE WHEN e > 0 THEN close * 1000 / e END, 4) AS per, round(CASE WHEN r > 0 THEN close * 1000 / r END, 4) AS psr FROM t ASOF LEFT JOIN bars b ON t.code = b.code AND b.bar_date <= t.d"""


def flows_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free cash flow, target book multiple and uplift of claims for every part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.floor("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
    tax = F.when(F.col("code") % 9 != 0, F.col("size") / 127)
    flow = fiscal.free_cash_flow(F.col("price"), tax, F.col("size"), F.col("size") * 2)
    book = fiscal.target_book_multiple((F.col("size") - 5) / 128, F.lit(0.09), F.when(F.col("code") % 4 != 0, F.lit(0.03)), F.lit(11.0))
    s = lambda at, *names: F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col("code") + at) % len(names) + 1).cast("int"))
    claims = p.select("code", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "size").select("code", (F.col("size") * F.col("k") - 10).alias("value"), s(0, "pct", "absolute", "other").alias("unit"), s(F.col("k"), "segment", "company").alias("scope"), (F.col("k") * 20 - 20).cast("double").alias("share"), s(F.col("k"), "revenue", "profit", "other").alias("metric"), (F.col("k") + F.col("code") % 5 == 5).alias("refuted"))
    base = p.select("code", F.col("price").alias("revenue"), (F.col("size") * 4 - 8).alias("income"), F.lit(0.25).alias("margin"))
    up = fiscal.claim_uplift(claims, base)
    return p.select("code", flow.alias("fcff"), book.alias("book")).join(up, "code", "left").select("code", "fcff", "book", F.round("uplift", 9).alias("uplift"), "claims")


FLOWS_AND_TARGETS = """WITH p AS (SELECT p_partkey AS code, floor(p_retailprice) AS price, p_size::DOUBLE AS size FROM part),
c AS (SELECT code, price, size * 4 - 8 AS income, size * k - 10 AS v, ['pct', 'absolute', 'other'][code % 3 + 1] AS unit, ['segment', 'company'][(code + k) % 2 + 1] AS scope, k * 20 - 20 AS share, ['revenue', 'profit', 'other'][(code + k) % 3 + 1] AS metric FROM p, range(1, 4) t(k) WHERE k + code % 5 <> 5),
s AS (SELECT *, CASE WHEN unit = 'absolute' THEN v / price WHEN unit = 'pct' AND scope = 'segment' AND share > 0 THEN v / 100 * share / 100 WHEN unit = 'pct' AND scope = 'company' THEN v / 100 END AS sales FROM c WHERE v > 0),
g AS (SELECT code, CASE WHEN metric = 'revenue' AND income > 0 THEN sales * price * 0.25::DOUBLE / income WHEN metric = 'profit' THEN sales END AS gain FROM s WHERE sales > 0), u AS (SELECT code, sum(gain) AS uplift, count(*) AS claims FROM g WHERE gain > 0 GROUP BY 1),
b AS (SELECT code, (size - 5) / 128 AS roe FROM p)
SELECT code, round(price * (1 - CASE WHEN code % 9 <> 0 THEN least(size / 127, 0.35::DOUBLE) END) + size - size * 2, 2) AS fcff,
  coalesce(CASE WHEN code % 4 <> 0 AND roe > 0 AND (roe - 0.03::DOUBLE) / (0.09::DOUBLE - 0.03::DOUBLE) > 0 THEN round((roe - 0.03::DOUBLE) / (0.09::DOUBLE - 0.03::DOUBLE), 2) END, CASE WHEN roe > 0 THEN round(11::DOUBLE * roe, 2) END) AS book, round(uplift, 9) AS uplift, claims
FROM p JOIN b USING (code) LEFT JOIN u USING (code)"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of components for each code and year, in other units, against its balance."""
    q = views.quarters(spark, sf_dir).select((F.col("code") * 10_000 + F.col("y")).alias("code"), F.concat(F.lit("c"), F.col("q").cast("string")).alias("leaf"), F.round("revenue").alias("amount"))
    one = q.select("code", F.lit("consolidated").alias("tab"), "leaf", F.when((F.col("code") % 4 == 0) & (F.col("leaf") == "c2"), F.col("amount") + 7).otherwise(F.col("amount") * 1000).alias("amount"))
    two = q.select("code", F.lit("separate").alias("tab"), "leaf", F.when((F.col("code") % 3 == 0) | (F.col("leaf") == "c1"), F.col("amount")).otherwise(F.col("amount") + 3).alias("amount"))
    return fiscal.reconcile(one.unionByName(two), q, [1.0, 1000.0, 1000000.0], "c1")


RECONCILED = f"""WITH {QUARTERS}, q AS (SELECT code * 10000 + y AS code, 'c' || q AS leaf, round(revenue) AS amount FROM quarters),
c AS (SELECT code, 'consolidated' AS tab, leaf, CASE WHEN code % 4 = 0 AND leaf = 'c2' THEN amount + 7 ELSE amount * 1000 END AS a FROM q UNION ALL SELECT code, 'separate', leaf, CASE WHEN code % 3 = 0 OR leaf = 'c1' THEN amount ELSE amount + 3 END FROM q),
h AS (SELECT code, tab, scale, count(*) AS n, bool_or(leaf = 'c1') AS ok FROM c JOIN q USING (code, leaf), (VALUES (1), (1000), (1000000)) s(scale) WHERE abs(amount * scale - a) < 0.5 GROUP BY 1, 2, 3),
m AS (SELECT code, tab, max(n) AS matches FROM h GROUP BY 1, 2 HAVING bool_or(ok)) SELECT code, tab, matches FROM (SELECT *, max(matches) OVER (PARTITION BY code) AS most FROM m) WHERE matches = most"""


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of each nation from its sales, as a map."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    per = c.groupBy(F.col("c_nationkey").alias("code")).agg(F.sum("c_acctbal").alias("cash"), F.count("*").cast("double").alias("shares"))
    sold = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("code")).agg(F.sum("o_totalprice").alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("net_income"))
    names = ("cash", "shares", "revenue", "net_income")
    return per.join(sold, "code").select("code", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("values"))


_MINE = {"cash_turn": "revenue / cash", "margin": "net_income / revenue", "per_share": "round(net_income / shares, 2)", "spread": "abs(cash - base) / revenue", "none": "inventories / revenue", "zero": "revenue / (cash - cash)"}


def ratio_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statement(spark, sf_dir)
    found = ratios.ratios(F.col("values"), _MINE, {"base": "revenue - net_income"})
    return s.select("code", *[F.round(c, 6).alias(n) for n, c in found.items()])


RATIO_ENGINE = """WITH a AS (SELECT c_nationkey AS code, sum(c_acctbal) AS cash, count(*)::DOUBLE AS shares FROM customer GROUP BY 1),
b AS (SELECT c_nationkey AS code, sum(o_totalprice) AS revenue, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS ni FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT code, round(revenue / nullif(cash, 0), 6) AS cash_turn, round(ni / revenue, 6) AS margin, round(round_even(ni / shares, 2), 6) AS per_share, round(abs(cash - (revenue - ni)) / revenue, 6) AS spread, NULL::DOUBLE AS "none", NULL::DOUBLE AS zero FROM a JOIN b USING (code)"""


_GIVEN = sorted({n for f, _, _ in ratios.RATIOS.values() for n in ratios.names(f)} - set(ratios.RATIOS) | {f"{n}:{state}" for f, _, _ in ratios.RATIOS.values() for n in re.findall(r"avg\((\w+)\)", f) for state in ("opening", "closing")})
_VALUE_OF = {n: f"CASE WHEN (code + {i}) % 23 <> 0 THEN CAST((code * 37 + {i} * 101) % 997 + 3 AS DOUBLE) / 7 END" for i, n in enumerate(_GIVEN)}
_STORED = {"per": "CASE WHEN code % 4 = 0 THEN 12.5 END", "roe": "CASE WHEN code % 3 = 0 THEN 8.0 END", "pbr": "0.0"}
_INDUSTRY = "CASE CAST(code % 5 AS INT) WHEN 0 THEN 'bank' WHEN 1 THEN 'insurance' WHEN 2 THEN 'securities' END"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, stored ratios and the industry of every supplier, made from its id."""
    codes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    as_map = lambda of: F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in of]), F.array(*[F.expr(e).cast("double") for e in of.values()])), lambda _, v: v.isNotNull())
    return codes.select("code", F.expr(_INDUSTRY).alias("industry"), as_map(_VALUE_OF).alias("values"), as_map(_STORED).alias("stored"))


def all_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every definition for every company."""
    return ratios.company_ratios(_statements(spark, sf_dir)).select("code", "ratio", F.round("value", 6).alias("value"), "source")


def _ratio_sql(formula: str) -> str:
    """A formula as SQL over columns that are named like its accounts."""
    avg = re.sub(r"avg\((\w+)\)", r'coalesce(("\1@opening" + "\1@closing") / 2, "\1@closing", "\1")', formula)
    return re.sub(r'(?<!["\w@])([A-Za-z_]\w*)((?::[a-z]+)?)(?![\w"(@])', lambda m: f'"{m[1]}{m[2]}"', avg).replace("@", ":")


_EXPANDED = ratios.expand({k: f for k, (f, _, _) in ratios.RATIOS.items()})
_COLUMNS = ", ".join(f'{e} AS "{n}"' for n, e in {**{n: "NULL::DOUBLE" for n in {x for f in _EXPANDED.values() for x in re.findall(r"avg\((\w+)\)", f)} - set(_VALUE_OF)}, **_VALUE_OF}.items())
_STATEMENTS = f"c AS (SELECT s_suppkey AS code FROM supplier), v AS (SELECT code, {_INDUSTRY} AS industry, {_COLUMNS} FROM c)"


def _scaled(name: str) -> str:
    return f"({_ratio_sql(_EXPANDED[name])}) * {100 if ratios.RATIOS[name][1] == 'percentage' else 1}"


ALL_RATIOS = f"WITH {_STATEMENTS} " + " UNION ALL ".join(
    f"SELECT code, '{name}' AS ratio, round(coalesce({_STORED.get(name, 'NULL::DOUBLE')}, {_scaled(name)}), 6) + 0.0 AS value, CASE WHEN {_STORED.get(name, 'NULL::DOUBLE')} IS NOT NULL THEN 'stored' WHEN {_scaled(name)} IS NOT NULL THEN 'computed' ELSE 'missing' END AS source FROM v WHERE industry IS NULL"
    + (" OR true" if not tags else "".join(f" OR industry = '{t}'" for t in tags.split()))
    for name, (_, _, tags) in ratios.RATIOS.items()
)


def ratio_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ratios against computed ones: a tenth of them off by more than half a percent."""
    s = _statements(spark, sf_dir).select("code", "values")
    computed = ratios.ratios(F.col("values"), {k: f for k, (f, _, _) in ratios.RATIOS.items()})
    kept = {"psr": computed["psr"] * F.when(F.col("code") % 10 == 0, 1.0625).otherwise(1.0), "roa": computed["roa"] * 100, "eps": F.lit(0.0)}
    stored = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in kept]), F.array(*kept.values())), lambda _, v: v.isNotNull())
    return ratios.validated(s.withColumn("stored", stored)).select("code", "ratio", F.round("stored", 6).alias("stored"), "ok")


RATIO_VALIDATION = f"""WITH {_STATEMENTS} SELECT code, 'psr' AS ratio, round(({_scaled("psr")}) * CASE WHEN code % 10 = 0 THEN 1.0625 ELSE 1 END, 6) AS stored, code % 10 <> 0 AS ok FROM v WHERE {_scaled("psr")} IS NOT NULL
UNION ALL SELECT code, 'roa', round({_scaled("roa")}, 6), true FROM v WHERE {_scaled("roa")} IS NOT NULL
UNION ALL SELECT code, 'eps', 0, coalesce(abs(round(({_scaled("eps")}) * 100, 2)) <= 0.5, false) FROM v"""

DICTIONARY = [("id", "BS_CA_CASH", "BS_CA_CASH"), ("taxonomy", "Cash", "BS_CA_CASH"), ("name", "cash and equivalents", "BS_CA_CASH"), ("alias", "cash", "BS_CA_CASH"), ("name", "sales", "IS_REV_TOTAL"), ("english", "revenue", "IS_REV_TOTAL"), ("alias", "cash and equivalents", "BS_CA_ST_FIN"), ("taxonomy", "sales (net)", "IS_OTHER")]
TERMS = ["BS_CA_CASH", "Cash", "cash", "cash and  equivalents", "sales (restated)", "sales (net)", "revenue [note 3]", "Cash (x)", "unknown"]


def account_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of accounts as they are reported, one for each customer, under the names of the ontology."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(t) for t in TERMS]), (F.col("c_custkey") % len(TERMS) + 1).cast("int")).alias("term"))
    got = ratios.resolve_accounts(c, F.broadcast(spark.createDataFrame(DICTIONARY, "via string, key string, id string")))
    return got.groupBy("term", "id", "via").agg(F.count("*").alias("n"))


ACCOUNT_NAMES = f"""WITH t AS (SELECT {TERMS}[c_custkey % {len(TERMS)} + 1] AS term FROM customer)
SELECT term, CASE WHEN term IN ('BS_CA_CASH', 'Cash', 'cash', 'cash and  equivalents') THEN 'BS_CA_CASH' WHEN term = 'sales (net)' THEN 'IS_OTHER' WHEN term IN ('sales (restated)', 'revenue [note 3]') THEN 'IS_REV_TOTAL' END AS id,
  CASE term WHEN 'BS_CA_CASH' THEN 'id' WHEN 'Cash' THEN 'taxonomy' WHEN 'cash' THEN 'alias' WHEN 'cash and  equivalents' THEN 'name' WHEN 'sales (restated)' THEN 'name' WHEN 'sales (net)' THEN 'taxonomy' WHEN 'revenue [note 3]' THEN 'english' END AS via, count(*) AS n FROM t GROUP BY 1"""


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples and the dividend model over parts: price, profit and book from their columns."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    eps, bps, shares = F.col("price") / 12 - 80, F.col("price") / 1.5, F.col("size") + 1
    return p.select(
        "code", F.round(valuation.per_target(eps, F.lit(11.0)), 4).alias("per"), F.round(valuation.pbr_target(bps, F.lit(1.2)), 4).alias("pbr"),
        F.round(valuation.ev_target(F.col("price"), F.lit(7.0), F.col("size") * 200, shares), 4).alias("ev_ebitda"),
        F.round(valuation.ddm_target(F.col("size"), F.lit(0.03), F.lit(0.08)), 4).alias("ddm"),
    )


VALUATIONS = """SELECT p_partkey AS code, CASE WHEN p_retailprice / 12 - 80 > 0 THEN round((p_retailprice / 12 - 80) * 11, 4) END AS per, round(p_retailprice / 1.5::DOUBLE * 1.2::DOUBLE, 4) AS pbr,
  CASE WHEN p_retailprice * 7 - p_size * 200 > 0 THEN round((p_retailprice * 7 - p_size * 200) / (p_size + 1), 4) END AS ev_ebitda, round(p_size * 1.03::DOUBLE / (0.08::DOUBLE - 0.03::DOUBLE), 4) AS ddm FROM part"""


def multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward multiple, discounted flows and the blend of six methods for every part."""
    p = table(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    p = barstore.dealt(p.where("price > 0"))  # without a price no method has a target; rows are narrow and their work is not: a few splits of a small file would hold it all
    g, roe, rate = F.col("size") / 200, F.lit(0.15), F.lit(0.09)
    moat = F.when(F.col("size") > 30, "strong").when(F.col("size") > 10, "medium").otherwise("weak")
    years = valuation.cap_years(roe, rate, moat)
    multiple = valuation.forward_multiple(g, roe, rate, F.lit(0.025), years)
    dcf = valuation.dcf_target(F.col("price"), g, F.lit(5), F.lit(0.025), rate, F.lit(0.0), F.lit(10.0), roe, moat)
    base = p.select("code", "size", "price", multiple.alias("multiple"), dcf.alias("dcf"))
    targets = {
        "per": F.col("price") / 10 * F.col("multiple"), "pbr": F.col("price") * 1.1, "ev_ebitda": F.col("price") * 1.3, "dcf": F.col("dcf"),
        "ddm": valuation.ddm_target(F.col("price") / 20, F.lit(0.02), rate), "ggm_dcf": valuation.ggm_dcf_target(F.col("price"), g / 5, rate, F.col("size") * 100, F.lit(10.0)),
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in valuation.FIT]), (F.col("code") % 5 + 1).cast("int"))
    fit = lambda m: valuation.fit_of(m, kind, F.col("size") / 10, F.col("code") % 11 == 0)
    rows = [valuation.target_row(t, F.lit("low" if m in ("dcf", "ggm_dcf") else "medium"), fit(m), F.col("code") % 5 == 0) for m, t in targets.items()]
    out = base.select("code", "multiple", "dcf", valuation.blended(F.array(*rows)).alias("b"))
    return out.select("code", F.round("b.target", 7).alias("target"), "b.methods", "b.kept", "multiple", F.round("dcf", 4).alias("dcf"))


def _valued_sql() -> str:
    """The same folds as recursion over years, and the blend as windows."""
    fit = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{m}' AS method, {f}::DOUBLE AS fit" for k, row in valuation.FIT.items() for m, f in row.items())
    kinds = str(list(valuation.FIT))
    return f"""WITH RECURSIVE p AS (SELECT p_partkey AS code, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, p_size / 200::DOUBLE AS g, CASE WHEN p_size > 30 THEN 10 WHEN p_size > 10 THEN 6 ELSE 3 END::DOUBLE AS base FROM part),
c AS (SELECT *, 0.15::DOUBLE AS roe, 0.09::DOUBLE AS r, 0.025::DOUBLE AS t FROM p),
d AS (SELECT *, least(g, roe) AS g0, round(least(12::DOUBLE, base * (0.5::DOUBLE + (roe - r) / (roe - r + r))), 1) AS cap, greatest(r, t + 0.045::DOUBLE) AS rd FROM c),
e AS (SELECT *, CAST(round_even(cap, 0) AS INTEGER) AS n, greatest(1, CAST(round_even(round(least(12::DOUBLE, base * (0.5::DOUBLE + (roe - rd) / (roe - rd + rd))), 1) / 2, 0) AS INTEGER)) AS half, (g - t) > 0.08::DOUBLE AS three FROM d),
f AS (SELECT *, CASE WHEN three THEN half ELSE 5 END AS plateau, CASE WHEN three THEN half ELSE 0 END AS fade FROM e),
fwd(code, k, pv, eps, d) AS (
  SELECT code, 0, 0::DOUBLE, 1::DOUBLE, 1::DOUBLE FROM f UNION ALL
  SELECT w.code, w.k + 1, w.pv + CASE WHEN s.rk > 0 THEN greatest(0::DOUBLE, 1 - s.gk / s.rk) ELSE 0 END * (w.eps * (1 + s.gk)) / (w.d * (1 + s.r)), w.eps * (1 + s.gk), w.d * (1 + s.r)
  FROM fwd w JOIN (SELECT code, r, n, k, g0 + (t - g0) * (greatest(0, k - n) / n::DOUBLE) AS gk, roe + (r - roe) * (greatest(0, k - n) / n::DOUBLE) AS rk FROM f, range(1, 25) y(k)) s ON s.code = w.code AND s.k = w.k + 1 WHERE w.k < 2 * s.n),
m AS (SELECT f.code, round_even((pv + (1 - t / r) * eps * (1 + t) / (r - t) / d) / (1 + g0), 1) AS multiple FROM f JOIN fwd ON f.code = fwd.code AND fwd.k = 2 * n),
flow(code, k, pv, f, d) AS (
  SELECT code, 0, 0::DOUBLE, price, 1::DOUBLE FROM f UNION ALL
  SELECT w.code, w.k + 1, w.pv + w.f * (1 + s.gk) / (w.d * (1 + s.rd)), w.f * (1 + s.gk), w.d * (1 + s.rd)
  FROM flow w JOIN (SELECT code, rd, plateau + fade AS years, k, g + (t - g) * CASE WHEN k > plateau THEN (k - plateau) / fade::DOUBLE ELSE 0 END AS gk FROM f, range(1, 25) y(k)) s ON s.code = w.code AND s.k = w.k + 1 WHERE w.k < s.years),
v AS (SELECT f.code, (pv + flow.f * (1 + t) / (rd - t) / d) / 10 AS dcf FROM f JOIN flow ON f.code = flow.code AND flow.k = plateau + fade),
base AS (SELECT f.*, multiple, CASE WHEN dcf > 0 THEN dcf END AS dcf, CASE WHEN price * (1 + g / 5) / (r - g / 5) - size * 100 > 0 THEN (price * (1 + g / 5) / (r - g / 5) - size * 100) / 10 END AS ggm, price / 20 * 1.02::DOUBLE / (r - 0.02::DOUBLE) AS ddm FROM f JOIN m USING (code) JOIN v USING (code)),
long AS (SELECT code, size, unnest(['per', 'pbr', 'ev_ebitda', 'dcf', 'ddm', 'ggm_dcf']) AS method, unnest([price / 10 * multiple, price * 1.1::DOUBLE, price * 1.3::DOUBLE, dcf, ddm, CASE WHEN r > g / 5 THEN ggm END]) AS target FROM base),
fit AS ({fit}),
j AS (SELECT code, method, target, CASE WHEN method IN ('dcf', 'ggm_dcf') THEN 1::DOUBLE ELSE 2 END AS c,
  CASE WHEN method = 'ddm' AND size / 10 < 1.5 THEN 0 WHEN method IN ('per', 'dcf') AND code % 11 = 0 THEN 0 ELSE fit END AS fit, CASE WHEN code % 5 = 0 THEN 1.2::DOUBLE ELSE 0.6::DOUBLE END AS most
  FROM long JOIN fit USING (method) WHERE kind = {kinds}[code % 5 + 1] AND target > 0),
a AS (SELECT *, count(*) OVER (PARTITION BY code) AS methods, count(*) FILTER (fit > 0) OVER (PARTITION BY code) AS fitting FROM j),
b AS (SELECT *, list_sort(list(target) OVER (PARTITION BY code)) AS ts FROM a WHERE fit > 0 OR fitting = 0),
o AS (SELECT *, (target - ts[len(ts) // 2 + 1]) / ts[len(ts) // 2 + 1] AS dev FROM b),
k AS (SELECT *, dev <= most AND dev >= -0.6::DOUBLE AS inside, count(*) FILTER (dev <= most AND dev >= -0.6::DOUBLE) OVER (PARTITION BY code) AS n_inside FROM o),
z AS (SELECT code, max(methods) AS methods, count(*) AS kept, CASE WHEN sum(c * fit) > 0 THEN sum(target * c * fit) / sum(c * fit) ELSE sum(target * c) / sum(c) END AS target FROM k WHERE inside OR n_inside = 0 GROUP BY 1)
SELECT code, round(target, 7) AS target, methods, kept, multiple, round(dcf, 4) AS dcf FROM z JOIN base USING (code)"""


MULTIPLES = _valued_sql()

QUERIES = {
    "w43_growth": growth,
    "w32_ttm": ttm,
    "w33_discrete_quarters": discrete,
    "a23_incremental_margin": margin,
    "w40_growth_ensemble": ensemble,
    "w35_span_ttm": span_ttm,
    "s10_g18_company_facts": company_facts,
    "g17_known_facts": known_facts,
    "w37_w47_cycle": rolling_and_recent,
    "w41_w42_long_growth": long_growth,
    "w44_annual_change": annual,
    "w45_rates_before": rates_before,
    "q9_w34_history": history,
    "f27_f29_targets": flows_and_targets,
    "j20_reconcile": reconciled,
    "g1_ratio_engine": ratio_engine,
    "g3_g8_all_ratios": all_ratios,
    "g6_ratio_validation": ratio_validation,
    "g9_account_names": account_names,
    "f22_f24_valuations": valuations,
    "q17_multi_method": multiples,
}
ORACLES = {
    "w43_growth": GROWTH,
    "w32_ttm": TTM,
    "w33_discrete_quarters": DISCRETE,
    "a23_incremental_margin": MARGIN,
    "w40_growth_ensemble": ENSEMBLE,
    "w35_span_ttm": SPAN_TTM,
    "s10_g18_company_facts": COMPANY_FACTS,
    "g17_known_facts": KNOWN_FACTS,
    "w37_w47_cycle": ROLLING,
    "w41_w42_long_growth": LONG_GROWTH,
    "w44_annual_change": ANNUAL,
    "w45_rates_before": RATES_BEFORE,
    "q9_w34_history": HISTORY,
    "f27_f29_targets": FLOWS_AND_TARGETS,
    "j20_reconcile": RECONCILED,
    "g1_ratio_engine": RATIO_ENGINE,
    "g3_g8_all_ratios": ALL_RATIOS,
    "g6_ratio_validation": RATIO_VALIDATION,
    "g9_account_names": ACCOUNT_NAMES,
    "f22_f24_valuations": VALUATIONS,
    "q17_multi_method": MULTIPLES,
}
