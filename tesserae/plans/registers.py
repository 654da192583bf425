"""Queries over registers, and over series whose windows are days or positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators import graphs, prices, registers
from tesserae.plans import company, scores
from tesserae.plans.graphs import resolution
from tesserae.sources import views
from tesserae.sources.views import BARS, UNIVERSE, table

CONSTANT = {"bond_3y": 0.03, "view": 0.5}


def latest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each kind of event as a rate, with constants for kinds that have none."""
    e = table(spark, sf_dir, "events")
    rates = e.select(F.col("event_type").alias("key"), F.struct("ts", "event_id").alias("day"), F.col("value").alias("percent"))
    asked = e.select(F.col("event_type").alias("key")).distinct().union(spark.createDataFrame([("bond_3y",), ("unknown",)], "key string"))
    return registers.latest_rates(rates, asked, CONSTANT).select("key", F.round("rate", 8).alias("rate"), F.date_format("day.ts", "yyyy-MM-dd HH:mm:ss").alias("day"))


LATEST_RATES = """WITH r AS (SELECT event_type AS key, round(arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) / 100, 8) AS rate, strftime(max(ts) FILTER (value IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS day FROM events GROUP BY 1)
SELECT * FROM r UNION ALL SELECT 'bond_3y', 0.03, NULL UNION ALL SELECT 'unknown', NULL, NULL"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: those of open orders are found after the others are stored; the twenty newest of each customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), "o_orderstatus")
    stored = o.where("o_orderstatus <> 'O'")
    found = o.withColumn("title", F.concat(F.lit("again "), "title"))  # everything is found once more
    every = stored.unionByName(registers.insert_new(stored, found, "accession", [F.asc("day")]))
    return registers.newest_of(every, "ticker", [F.desc("day"), F.desc("accession")], 20).select("ticker", "number", "accession", "title")


FILINGS = """SELECT o_custkey AS ticker, CAST(row_number() OVER w AS INTEGER) AS number, o_orderkey AS accession, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE 'again ' || o_orderpriority END AS title
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 20"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by company, year and segment: years up to 1998 are stored at twice the figure, years from 1997 on are found."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("segment")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("revenue"))
    stored = l.where("year <= 1998").withColumn("revenue", F.col("revenue") * 2)
    fresh = l.where("year >= 1997").withColumn("at", F.lit(1).cast("long"))
    return registers.segment_sales(stored, fresh, ["code", "year", "segment"], "at")


SEGMENTS = """WITH l AS (SELECT l_suppkey AS code, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS segment, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT code, year, segment, CASE WHEN year < 1997 THEN revenue * 2 ELSE revenue END AS revenue FROM l)
SELECT *, CASE WHEN sum(revenue) OVER w <> 0 THEN round(revenue / sum(revenue) OVER w * 100, 2) END AS ratio_pct FROM k WINDOW w AS (PARTITION BY code, year)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of parts with what reviewers did: some of the new ones rejected, some promoted, some both."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("m_id"))
    got = registers.review_states(resolution(spark, sf_dir), p.where("m_id % 3 = 0"), p.where("m_id % 7 = 0").withColumn("found", F.col("m_id") + 1_000_000))
    return got


STATES = """WITH r AS (SELECT p_partkey AS m_id, CASE WHEN p_partkey % 4 <> 3 THEN p_partkey END AS f, CASE p_partkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'new' END AS h FROM part)
SELECT m_id, CASE WHEN h = 'new' AND m_id % 7 = 0 THEN m_id + 1000000 ELSE f END AS found, CASE WHEN h = 'new' AND m_id % 7 = 0 THEN 'review' ELSE h END AS how, CASE WHEN h <> 'new' OR m_id % 7 = 0 THEN 'canonical' WHEN m_id % 3 = 0 THEN 'rejected' ELSE 'pending' END AS state FROM r"""

KNOWN = {"cap": ("market value", "gte,lte"), "per": ("price to earnings", "lte,lt"), "pbr": ("price to book", "lte,lt"), "roe": ("return on equity", "gte,gt"), "dividend": ("dividend yield", "gte"), "momentum": ("three-month return", "gte,lte,gt,lt,eq")}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters that a screen knows, with what the companies have to filter."""
    got = registers.filter_catalog(scores.companies(spark, sf_dir), KNOWN)
    return got.withColumns({c: F.round(c, 6) for c in ("least", "most")})


CATALOG = f"WITH {scores.COMPANIES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS id, '{label}' AS label, round(min(CAST({c} AS DOUBLE)), 6) AS least, round(max(CAST({c} AS DOUBLE)), 6) AS most, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS kinds, '{op}' AS op FROM companies" for c, (label, ops) in KNOWN.items() for op in ops.split(",")
)


def absent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their properties lack a key."""
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 5 != 0, F.col("props")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"other"'))))
    return e.groupBy("event_type", registers.without_key(F.col("props"), "k").alias("absent")).agg(F.count("*").alias("n"))


ABSENT = "WITH e AS (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN props ELSE replace(props, '\"k\"', '\"other\"') END AS p FROM events) SELECT event_type, coalesce(NOT list_contains(json_keys(p), 'k'), true) AS absent, count(*) AS n FROM e GROUP BY 1, 2"


def topdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's view from the top: its sector's flow, that of the sector that leads it, its market's, its own strength, and the score of these."""
    df = company.companies(spark, sf_dir)
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # chains of small tables: sector -> region -> the leading region -> its first sector of the same number
    place = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sector"), (F.col("n_nationkey") % 5).alias("number"), F.col("r_name").alias("region"))
    leaders = place.where("region in ('ASIA', 'EUROPE')").groupBy("number").agg(F.min("sector").alias("lead"))
    chain = place.join(leaders, "number", "left").select("sector", "lead")
    flows = scores._sector_flow(df, "sector").select("sector", F.col("flow_3m").alias("sector_flow"), F.col("flow_1m").alias("lead_flow"))
    markets = scores._sector_flow(df, "market").select("market", F.col("flow_3m").alias("index_flow"))
    out = df.join(F.broadcast(chain), "sector").join(F.broadcast(flows.select("sector", "sector_flow")), "sector", "left")  # a row for each sector
    out = out.join(F.broadcast(flows.select(F.col("sector").alias("lead"), "lead_flow")), "lead", "left").join(F.broadcast(markets), "market", "left")
    from tesserae.operators import scores as rules

    score = rules.score(rules.topdown_parts({"lead_sector": F.col("lead_flow"), "sector": F.col("sector_flow"), "index": F.col("index_flow"), "strength": F.col("strength")}))
    return out.select("code", "sector", "lead", "sector_flow", "lead_flow", "index_flow", "strength", score.alias("score"))


TOPDOWN = f"""WITH {company.COMPANIES}, place AS (SELECT n_name AS sector, n_nationkey % 5 AS number, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
chain AS (SELECT p.sector, l.lead FROM place p LEFT JOIN (SELECT number, min(sector) AS lead FROM place WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1) l USING (number)),
sf AS (SELECT sector, {scores._flow("3m")} AS sector_flow, {scores._flow("1m")} AS lead_flow FROM (SELECT sector, {scores._MEANS} FROM companies GROUP BY 1)), mf AS (SELECT market, {scores._flow("3m")} AS index_flow FROM (SELECT market, {scores._MEANS} FROM companies GROUP BY 1)),
j AS (SELECT c.code, c.sector, chain.lead, s.sector_flow, l.lead_flow, mf.index_flow, c.strength FROM companies c JOIN chain ON chain.sector = c.sector LEFT JOIN sf s ON s.sector = c.sector LEFT JOIN sf l ON l.sector = chain.lead LEFT JOIN mf ON mf.market = c.market)
SELECT *, {scores._TOPDOWN} AS score FROM j"""


def multiples_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PER, PBR and PSR of every quarter of every company: the last close up to its end over trailing profit, book (what accounts hold and profits leave) and revenue."""
    q = company.quarters(spark, sf_dir).withColumn("n", F.col("y") * 4 + F.col("q"))
    w = Window.partitionBy("code").orderBy("n")
    whole = F.lag("n", 3).over(w) == F.col("n") - 3
    last4 = w.rowsBetween(-3, 0)
    acc = views.universe(spark, sf_dir).select("code", (F.col("cap") * 100).alias("held"))
    ttm = q.select("code", "y", "q", "n", F.when(whole, F.sum("profit").over(last4)).alias("e"), F.when(whole, F.sum("revenue").over(last4)).alias("r"), F.sum("profit").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("left"))
    from tesserae.operators import fiscal

    ttm = ttm.join(acc, "code").withColumn("as_of", fiscal.quarter_end(F.col("y"), F.col("q"))).withColumn("book", F.col("held") + F.col("left"))
    closes = prices.as_of_close(views.bars(spark, sf_dir), ttm.select("code", "as_of"))
    ratio = lambda c: F.round(F.when(F.col(c) > 0, F.col("close") * company.SHARES / F.col(c)), 6)
    return ttm.join(closes, ["code", "as_of"]).select("code", "y", "q", "n", ratio("e").alias("per"), ratio("book").alias("pbr"), ratio("r").alias("psr"))


_HISTORY = f"""{BARS}, {UNIVERSE}, quarters_of AS ({company._QUARTERS.replace("{lineitem}", "lineitem")}), n AS (SELECT *, y * 4 + q AS n FROM quarters_of),
t AS (SELECT n.*, CASE WHEN lag(n, 3) OVER w = n - 3 THEN sum(profit) OVER (w ROWS 3 PRECEDING) END AS e, CASE WHEN lag(n, 3) OVER w = n - 3 THEN sum(revenue) OVER (w ROWS 3 PRECEDING) END AS r, cap * 100 + sum(profit) OVER (w ROWS UNBOUNDED PRECEDING) AS book, last_day(make_date(y, q * 3, 1)) AS d
  FROM n JOIN universe USING (code) WINDOW w AS (PARTITION BY code ORDER BY n)),
h AS (SELECT t.code, y, q, n, round(CASE WHEN e > 0 THEN close * {company.SHARES} / e END, 6) AS per, round(CASE WHEN book > 0 THEN close * {company.SHARES} / book END, 6) AS pbr, round(CASE WHEN r > 0 THEN close * {company.SHARES} / r END, 6) AS psr FROM t ASOF LEFT JOIN bars b ON t.code = b.code AND b.bar_date <= t.d)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiples_history(spark, sf_dir).drop("n")


HISTORY = f"WITH {_HISTORY} SELECT code, y, q, per, pbr, psr FROM h"


def bands(spark: SparkSession, sf_dir: str, most: int = 40) -> DataFrame:
    """Bands of the last forty positive multiples of each company."""
    h = multiples_history(spark, sf_dir)
    every = None
    for c in ("per", "pbr"):
        k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n")))  # the quarters of one company
        held = h.where(F.col(c) > 0).withColumn("k", k).where(F.col("k") <= most)
        got = prices.quantile_bands(held, "code", c).select("code", F.lit(c).alias("multiple"), "n", *[F.round(f"near_{p}", 6).alias(f"p{p}") for p in (25, 50, 75)], F.round("upper_median", 6).alias("upper_median"))
        every = got if every is None else every.unionByName(got)
    return every


BANDS = f"WITH {_HISTORY} " + " UNION ALL ".join(
    f"""SELECT code, '{c}' AS multiple, CAST(len(v) AS INTEGER) AS n, {", ".join(f"CASE WHEN len(v) >= 4 THEN v[CAST(round_even((len(v) - 1) * {p / 100}, 0) AS INTEGER) + 1] END AS p{p}" for p in (25, 50, 75))}, v[len(v) // 2 + 1] AS upper_median
FROM (SELECT code, list_sort(list({c})) AS v FROM (SELECT * FROM h WHERE {c} > 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC) <= 40) GROUP BY 1)""" for c in ("per", "pbr")
)


def rolling_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors' mean closes, and on each day the change from the first of the last 90 days, where the last 150 have 40 and more."""
    s = views.bars(spark, sf_dir).join(views.universe(spark, sf_dir).select("code", "sector"), "code").groupBy("sector", "bar_date").agg(F.avg("close").alias("close"))
    day = F.datediff("bar_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("sector").orderBy(day)
    past, n = F.first("close").over(w.rangeBetween(-90, 0)), F.count("*").over(w.rangeBetween(-150, 0))
    out = s.select("sector", "bar_date", n.alias("n"), F.round(F.when(past > 0, (F.col("close") - past) / past * 100), 6).alias("momentum"))
    return out.where("n >= 40")


MOMENTUM = f"""WITH {BARS}, {UNIVERSE}, s AS (SELECT sector, bar_date, avg(close) AS close FROM bars JOIN universe USING (code) GROUP BY 1, 2),
m AS (SELECT sector, bar_date, count(*) OVER (w RANGE BETWEEN INTERVAL 150 DAY PRECEDING AND CURRENT ROW) AS n, close, first_value(close) OVER (w RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS past FROM s WINDOW w AS (PARTITION BY sector ORDER BY bar_date))
SELECT sector, bar_date, n, CASE WHEN past > 0 THEN round((close - past) / past * 100, 6) + 0.0 END AS momentum FROM m WHERE n >= 40"""


#: Ratios of a company's quarter: margin, return on what equity was on average, turnover and growth of what was sold.
FORMULAS = {"margin": "profit / revenue", "roe": "profit / avg(equity)", "turnover": "revenue / avg(sold)", "equity_growth": "(equity:closing - equity:opening) / equity:opening", "lines_each": "revenue / lines"}


def ratio_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of every quarter of every company, from inputs that its statements give."""
    from tesserae.operators import inputs, ratios

    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("n")).agg(F.count("*").cast("double").alias("lines"))
    q = company.quarters(spark, sf_dir).withColumn("n", F.col("y") * 4 + F.col("q")).join(l, ["code", "n"])
    upto = Window.partitionBy("code").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    q = q.join(views.universe(spark, sf_dir).select("code", F.abs("cap").alias("held")), "code").select("code", "n", "revenue", "profit", "lines", (F.col("held") * 100 + F.sum("profit").over(upto)).alias("equity"), F.sum("revenue").over(upto).alias("sold"))
    rows = F.array(*[F.struct(F.lit(a).alias("account"), F.lit(k).alias("kind"), F.col(a).alias("amount")) for a, k in (("revenue", "flow"), ("profit", "flow"), ("lines", "flow"), ("equity", "stock"), ("sold", "stock"))])
    got = inputs.namespace(q.select("code", "n", F.inline(rows)))
    found = ratios.ratios(F.col("values"), FORMULAS)
    return got.select("code", "n", F.size("values").alias("inputs"), *[F.round(c, 6).alias(name) for name, c in found.items()])


RATIO_INPUTS = f"""WITH {UNIVERSE}, quarters_of AS ({company._QUARTERS.replace("{lineitem}", "lineitem")}), l AS (SELECT l_suppkey AS code, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INTEGER) AS n, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1, 2),
q AS (SELECT quarters_of.code, y * 4 + q AS n, revenue, profit, lines, abs(cap) * 100 + sum(profit) OVER w AS equity, sum(revenue) OVER w AS sold FROM quarters_of JOIN l ON l.code = quarters_of.code AND l.n = y * 4 + q JOIN universe ON universe.code = quarters_of.code WINDOW w AS (PARTITION BY quarters_of.code ORDER BY y * 4 + q ROWS UNBOUNDED PRECEDING)),
t AS (SELECT q.code, q.n, q.equity, q.sold, p.equity AS equity0, p.sold AS sold0, CASE WHEN lag(q.n, 3) OVER w = q.n - 3 THEN sum(q.revenue) OVER (w ROWS 3 PRECEDING) END AS r, CASE WHEN lag(q.n, 3) OVER w = q.n - 3 THEN sum(q.profit) OVER (w ROWS 3 PRECEDING) END AS e, CASE WHEN lag(q.n, 3) OVER w = q.n - 3 THEN sum(q.lines) OVER (w ROWS 3 PRECEDING) END AS k
  FROM q LEFT JOIN q p ON p.code = q.code AND p.n = q.n - 4 WINDOW w AS (PARTITION BY q.code ORDER BY q.n))
SELECT code, n, CAST(4 + CASE WHEN equity0 IS NULL THEN 0 ELSE 2 END + CASE WHEN r IS NULL THEN 0 ELSE 3 END AS INTEGER) AS inputs, CASE WHEN r <> 0 THEN round(e / r, 6) + 0.0 END AS margin, CASE WHEN coalesce((equity + equity0) / 2, equity) <> 0 THEN round(e / coalesce((equity + equity0) / 2, equity), 6) + 0.0 END AS roe,
  CASE WHEN coalesce((sold + sold0) / 2, sold) <> 0 THEN round(r / coalesce((sold + sold0) / 2, sold), 6) + 0.0 END AS turnover, CASE WHEN equity0 <> 0 THEN round((equity - equity0) / equity0, 6) + 0.0 END AS equity_growth, CASE WHEN k <> 0 THEN round(r / k, 6) END AS lines_each FROM t"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies and products: how many neighbours each has either way, and their shares."""
    e = views.edges(spark, sf_dir).withColumn("dst", F.col("dst") + 1_000_000)
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return graphs.neighbours(e, nodes).groupBy("node", "direction").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("share"))


NEIGHBOURS = f"WITH {views.EDGES} SELECT src AS node, 'out' AS direction, count(*) AS n, round(sum(share), 6) AS share FROM edges GROUP BY 1 UNION ALL SELECT dst + 1000000, 'in', count(*), round(sum(share), 6) FROM edges GROUP BY 1"

QUERIES = {
    "m6_latest_rates": latest_rates,
    "m18_filings": filings,
    "m17_segment_sales": segments,
    "g11_review_states": states,
    "p20_filter_catalog": catalog,
    "p9_absent_keys": absent_keys,
    "m14_j14_topdown": topdown,
    "q9_multiples_history": history,
    "a19_last_forty": bands,
    "w6_rolling_momentum": rolling_momentum,
    "g5_ratio_inputs": ratio_inputs,
    "j17_all_neighbours": neighbours,
}
ORACLES = {
    "m6_latest_rates": LATEST_RATES,
    "m18_filings": FILINGS,
    "m17_segment_sales": SEGMENTS,
    "g11_review_states": STATES,
    "p20_filter_catalog": CATALOG,
    "p9_absent_keys": ABSENT,
    "m14_j14_topdown": TOPDOWN,
    "q9_multiples_history": HISTORY,
    "a19_last_forty": BANDS,
    "w6_rolling_momentum": MOMENTUM,
    "g5_ratio_inputs": RATIO_INPUTS,
    "j17_all_neighbours": NEIGHBOURS,
}
