"""Companies as the tables show them: quarters, bars, orders and accounts of every supplier, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators import prices, screener
from tesserae.operators.screener import Criteria
from tesserae.operators.shared import stored
from tesserae.plans import scores as score_plans
from tesserae.plans.prices import STRENGTH
from tesserae.sources import views
from tesserae.sources.views import BARS, UNIVERSE, table

#: Shares of a company, in thousands.
SHARES = 1000
# Quarters of each supplier.  Profit is what discounts leave beyond a twentieth of the price.
_QUARTERS = """SELECT l_suppkey AS code, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (CAST(0.05 AS DECIMAL(4, 2)) - CAST(l_discount AS DECIMAL(4, 2)) + CAST(l_tax AS DECIMAL(4, 2)))) AS DOUBLE) AS profit
FROM {lineitem} GROUP BY 1, 2, 3"""
_ORDERS = """SELECT l_suppkey AS code, count(DISTINCT o_orderkey) AS coverage, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS buys
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE year(o_orderdate) >= 1998 GROUP BY 1"""
# Year over year, quarter over quarter, sums of four quarters without a gap; the newest quarter of each company.
_FUNDAMENTALS = """n AS (SELECT *, y * 4 + q AS n FROM quarters_of),
g AS (SELECT *, lag(n, 1) OVER w AS n1, lag(n, 3) OVER w AS n3, lag(n, 4) OVER w AS n4, lag(n, 7) OVER w AS n7, lag(revenue, 1) OVER w AS r1, lag(profit, 1) OVER w AS p1, lag(revenue, 4) OVER w AS r4, lag(profit, 4) OVER w AS p4,
  sum(revenue) OVER (PARTITION BY code ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rs, sum(profit) OVER (PARTITION BY code ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ps,
  sum(profit) OVER (PARTITION BY code ORDER BY n ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS ps0, sum(revenue) OVER (PARTITION BY code ORDER BY n ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS rs0, row_number() OVER (PARTITION BY code ORDER BY n DESC) AS k
  FROM n WINDOW w AS (PARTITION BY code ORDER BY n)),
f AS (SELECT code, y, q, CASE WHEN n1 = n - 1 THEN r1 END AS r1, CASE WHEN n1 = n - 1 THEN p1 END AS p1, CASE WHEN n4 = n - 4 THEN r4 END AS r4, CASE WHEN n4 = n - 4 THEN p4 END AS p4, revenue, profit,
  CASE WHEN n3 = n - 3 THEN rs END AS rs, CASE WHEN n3 = n - 3 THEN ps END AS ps, CASE WHEN n7 = n - 7 THEN rs0 END AS rs0, CASE WHEN n7 = n - 7 THEN ps0 END AS ps0 FROM g WHERE k = 1)
SELECT code, y, q, rs AS revenue_ttm, ps AS profit_ttm, CASE WHEN r4 > 0 THEN (revenue - r4) / r4 END AS revenue_yoy, CASE WHEN r1 > 0 THEN (revenue - r1) / r1 END AS revenue_qoq,
  CASE WHEN p4 > 0 THEN (profit - p4) / p4 END AS op_yoy, CASE WHEN p1 > 0 THEN (profit - p1) / p1 END AS op_qoq,
  CASE WHEN p4 IS NULL THEN NULL WHEN profit > 0 AND p4 > 0 THEN 'profit' WHEN profit > 0 THEN 'turnaround' WHEN p4 > 0 THEN 'deficit' ELSE 'loss' END AS op_status, CASE WHEN r4 > 0 AND revenue > 0 THEN profit / revenue - p4 / r4 END AS op_delta,
  CASE WHEN ps0 IS NULL OR ps IS NULL THEN NULL WHEN ps > 0 AND ps0 > 0 THEN 'profit' WHEN ps > 0 THEN 'turnaround' WHEN ps0 > 0 THEN 'deficit' ELSE 'loss' END AS net_status, CASE WHEN rs0 > 0 AND rs > 0 THEN ps / rs - ps0 / rs0 END AS net_delta,
  CASE WHEN ps0 > 0 THEN (ps - ps0) / ps0 END AS eps_yoy FROM f"""
# What both engines read: a row for each company from its last bar, newest quarter, orders, account and place.
_COMPANY = f"""SELECT u.code, u.name, u.sector, CASE WHEN u.market IN ('ASIA', 'EUROPE') THEN 'A' ELSE 'B' END AS market, CASE WHEN u.code % 17 = 0 THEN 'etf' ELSE 'stock' END AS kind, t.close, t.close * {SHARES} AS cap, t.traded, t.return_1 AS change_pct,
  CASE WHEN profit_ttm > 0 THEN t.close * {SHARES} / profit_ttm END AS per, CASE WHEN u.cap > 0 THEN t.close * {SHARES} / (u.cap * 100) END AS pbr, CASE WHEN revenue_ttm > 0 THEN t.close * {SHARES} / revenue_ttm END AS psr,
  CASE WHEN profit_ttm > 0 THEN (t.close * {SHARES} - u.cap) / (profit_ttm * 1.25) END AS ev_ebitda, CASE WHEN u.cap > 0 THEN profit_ttm / (u.cap * 100) * 100 END AS roe, CASE WHEN profit_ttm > 0 THEN profit_ttm * 0.3 / (t.close * {SHARES}) * 100 END AS dividend,
  eps_yoy, revenue_yoy, revenue_qoq, op_yoy, op_qoq, op_status, op_delta, net_status, net_delta, CAST(NULL AS TEXTTYPE) AS ebitda_status, CAST(NULL AS DOUBLE) AS ebitda_delta,
  t.return_60 AS momentum, t.near_high * 100 AS near_high, t.volume_ratio, CAST(NULL AS DOUBLE) AS foreign_delta, t.aligned, coalesce(t.close > t.ma120, false) AS above_long, CAST(NULL AS INT) AS stage, CAST(s.rating AS DOUBLE) AS strength, o.coverage, o.buys
FROM UNIVERSE_OF u LEFT JOIN LAST_OF t ON t.code = u.code LEFT JOIN RATED_OF s ON s.code = u.code LEFT JOIN FUND_OF f ON f.code = u.code LEFT JOIN ORDERS_OF o ON o.code = u.code"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUARTERS, lineitem=table(spark, sf_dir, "lineitem"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH quarters_of AS (SELECT * FROM {q}), " + _FUNDAMENTALS, q=quarters(spark, sf_dir))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each company."""
    bars = views.bars(spark, sf_dir)
    w = Window.partitionBy("code").orderBy("bar_date")
    with_traded = prices.last_bars(bars, 2).withColumn("traded", F.col("close") * F.col("volume")).withColumn("change", F.lag("close").over(w))
    bars = prices.last_bars(bars)
    last = prices.technicals(bars).groupBy("code").agg(F.max_by(F.struct("close", "ma120", "near_high", "aligned", "volume_ratio", "return_60"), "bar_date").alias("t")).select("code", "t.*")
    traded = with_traded.groupBy("code").agg(F.max_by("traded", "bar_date").alias("traded"), F.max_by(F.when(F.col("change") > 0, (F.col("close") / F.col("change") - 1) * 100), "bar_date").alias("return_1"))
    parts = {"LAST_OF": last.join(traded, "code"), "RATED_OF": prices.strength_ratings(bars), "FUND_OF": fundamentals(spark, sf_dir), "UNIVERSE_OF": views.universe(spark, sf_dir), "ORDERS_OF": spark.sql(_ORDERS, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))}
    text = _COMPANY.replace("TEXTTYPE", "STRING")
    for name in parts:
        text = text.replace(name, "{" + name + "}")
    return stored(spark.sql(text, **parts), "companies")


COMPANIES = f"""{BARS}, {UNIVERSE}, quarters_of AS ({_QUARTERS.replace("{lineitem}", "lineitem")}), fund_of AS (WITH {_FUNDAMENTALS}), orders_of AS ({_ORDERS.replace("{lineitem}", "lineitem").replace("{orders}", "orders")}),
rated_of AS ({STRENGTH.replace(f"WITH {BARS}, ", "WITH ")}),
tech AS (SELECT *, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20, CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS ma60,
  CASE WHEN count(*) OVER (w ROWS 119 PRECEDING) = 120 THEN avg(close) OVER (w ROWS 119 PRECEDING) END AS ma120, max(high) OVER (w ROWS 251 PRECEDING) AS top, lag(close, 60) OVER w AS c60, lag(close) OVER w AS c1,
  CASE WHEN count(volume) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) = 50 THEN avg(volume) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS usual, lead(bar_date) OVER w AS nxt FROM bars WINDOW w AS (PARTITION BY code ORDER BY bar_date)),
last_of AS (SELECT code, close, ma120, close / top AS near_high, CASE WHEN ma20 IS NOT NULL AND ma60 IS NOT NULL AND ma120 IS NOT NULL THEN close > ma20 AND ma20 > ma60 AND ma60 > ma120 END AS aligned, CASE WHEN usual > 0 THEN volume / usual END AS volume_ratio,
  CASE WHEN c60 > 0 THEN round((close / c60 - 1) * 100, 1) END AS return_60, close * volume AS traded, CASE WHEN c1 > 0 THEN (close / c1 - 1) * 100 END AS return_1 FROM tech WHERE nxt IS NULL),
companies AS ({_COMPANY.replace("TEXTTYPE", "VARCHAR").replace("UNIVERSE_OF", "universe")})"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the five scores."""
    df = companies(spark, sf_dir)
    return score_plans.with_axes(df)


_AXES = score_plans.AXES_CTE.replace(f"{score_plans.COMPANIES}, ", "").replace("SELECT code, sector, market, cap,", "SELECT companies.*,")
SCORED = f"{COMPANIES}, {_AXES}"

#: A screen of each strategy, each with other questions.
SCREENS = {
    "growth": (Criteria(cap_min=1000, revenue_yoy_min=-0.5, op_yoy_min=-2, revenue_qoq_min=-0.9, op_qoq_min=-5, op_growth="growth"), None),
    "value": (Criteria(per_max=60, pbr_max=100, roe_min=-100, dividend_min=0.01, funds=True), None),
    "trend": (Criteria(momentum_min=-60, momentum_max=200, liquidity_min=10, coverage="has", recent_buy=True), "market_cap"),
    "topdown": (Criteria(market="B", cap_max=1e9), "trading_value"),
    "overall": (Criteria(net_status="profit"), None),
}


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five strategies over all companies: every company that a screen finds, with its place."""
    df = stored(scored(spark, sf_dir), "scored")
    every = [screener.screen(df, c, strategy, sort).select(F.lit(strategy).alias("strategy"), "code", "score", "place", "total") for strategy, (c, sort) in SCREENS.items()]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


_STOCKS = "kind = 'stock' AND NOT regexp_matches(name, '우[A-C]?$')"
_WHERE = {
    "growth": f"cap >= 1000 AND revenue_yoy >= -0.5 AND op_yoy >= -2 AND revenue_qoq >= -0.9 AND op_qoq >= -5 AND op_yoy > 0 AND {_STOCKS}",
    "value": "per > 0 AND per <= 60 AND pbr > 0 AND pbr <= 100 AND roe >= -100 AND dividend >= 0.01",
    "trend": f"momentum >= -60 AND momentum <= 200 AND (traded IS NULL OR traded <= 0 OR traded >= 10) AND coverage > 0 AND buys > 0 AND {_STOCKS}",
    "topdown": f"market = 'B' AND cap <= 1e9 AND {_STOCKS}",
    "overall": f"net_status = 'profit' AND overall IS NOT NULL AND {_STOCKS}",
}
_ORDER = {"trend": "coalesce(cap, 0) ASC", "topdown": "coalesce(traded, 0) DESC"}
SCREENS_SQL = f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, code, {s} AS score, row_number() OVER (ORDER BY {_ORDER.get(s, f'coalesce({s}, -1) DESC')}, code) AS place, count(*) OVER () AS total FROM axes WHERE cap IS NOT NULL AND close IS NOT NULL AND {where}" for s, where in _WHERE.items()
)


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company beside the companies of its sector and size: each peer with its own latest multiples, whenever they are from, and its four axes."""
    df = stored(scored(spark, sf_dir), "scored")
    latest = latest_multiples(spark, sf_dir)
    held = df.select("code", "sector", "cap").where("cap is not null")
    # the sector's companies in order of value: the two above and the two below are peers
    w = Window.partitionBy("sector").orderBy("cap", "code")
    near = held.select("code", F.array(*[F.lead("code", i).over(w) if i > 0 else F.lag("code", -i).over(w) for i in (-2, -1, 1, 2)]).alias("peers"))
    pairs = near.select("code", F.explode("peers").alias("peer")).where("peer is not null")
    values = df.select(F.col("code").alias("peer"), F.round("per", 6).alias("per"), F.round("pbr", 6).alias("pbr"), *screener.STRATEGIES)
    return pairs.join(values, "peer").join(latest.withColumnRenamed("code", "peer"), "peer", "left")


def latest_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, psr, psr_at, ev, ev_at: the newest quarter that has each of them, looked for apart."""
    q = quarters(spark, sf_dir)
    at = (F.col("y") * 10 + F.col("q")).alias("at")
    value = q.select("code", at, F.when(F.col("revenue") > 0, F.col("code") * 100 / F.col("revenue")).alias("psr"), F.when(F.col("profit") > 0, F.col("code") * 100 / F.col("profit")).alias("ev"))
    newest = lambda c: F.max_by(F.struct(F.round(c, 6).alias("v"), "at"), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    got = value.groupBy("code").agg(newest("psr"), newest("ev"))
    return got.select("code", F.col("psr.v").alias("psr"), F.col("psr.at").alias("psr_at"), F.col("ev.v").alias("ev"), F.col("ev.at").alias("ev_at"))


PEERS = f"""WITH {SCORED}, v AS (SELECT code, y * 10 + q AS t, CASE WHEN revenue > 0 THEN round(code * 100 / revenue, 6) END AS psr, CASE WHEN profit > 0 THEN round(code * 100 / profit, 6) END AS ev FROM quarters_of),
l AS (SELECT code, arg_max(psr, t) FILTER (psr IS NOT NULL) AS psr, max(t) FILTER (psr IS NOT NULL) AS psr_at, arg_max(ev, t) FILTER (ev IS NOT NULL) AS ev, max(t) FILTER (ev IS NOT NULL) AS ev_at FROM v GROUP BY 1),
k AS (SELECT code, sector, row_number() OVER (PARTITION BY sector ORDER BY cap, code) AS k FROM axes WHERE cap IS NOT NULL)
SELECT a.code, b.code AS peer, round(x.per, 6) AS per, round(x.pbr, 6) AS pbr, x.growth, x.value, x.trend, x.topdown, x.overall, l.psr, l.psr_at, l.ev, l.ev_at
FROM k a JOIN k b ON a.sector = b.sector AND b.k BETWEEN a.k - 2 AND a.k + 2 AND b.k <> a.k JOIN axes x ON x.code = b.code LEFT JOIN l ON l.code = b.code"""


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the latest multiples and returns of each industry's members."""
    df = companies(spark, sf_dir)
    return df.groupBy("sector").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("per", "pbr", "roe")])


AVERAGES = f"WITH {COMPANIES} SELECT sector, count(*) AS n, round(avg(per), 6) AS per, round(avg(pbr), 6) AS pbr, round(avg(roe), 6) AS roe FROM companies GROUP BY 1"


QUERIES = {"q1_p2_screens": screens, "q16_peer_multiples": peers, "a16_multiples_average": averages}
ORACLES = {"q1_p2_screens": SCREENS_SQL, "q16_peer_multiples": PEERS, "a16_multiples_average": AVERAGES}
