"""Queries of a store's upkeep, of ownership, and of text rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions import texts
from tesserae.operators import ledger
from tesserae.sources import views
from tesserae.sources.views import BARS, UNIVERSE, table


def _financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of each order, some in a wrong unit."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = F.round("o_totalprice").cast("double")
    return o.select(
        (F.col("o_custkey") % 40).alias("code"), k.alias("id"), F.when(k % 97 == 0, amount * 1e8).otherwise(amount).alias("revenue"),
        F.when(k % 50 == 1, amount * 1e8).when(k % 31 == 2, amount * 20).when(k % 7 != 3, amount / 4).alias("ebitda"), F.when(k % 50 == 1, amount * 1e9).when(k % 50 == 2, amount).alias("net_debt"), (amount / 1000).alias("multiple"),
    )


_FINANCIALS = """f AS (SELECT o_custkey % 40 AS code, o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN round(o_totalprice) * 1e8 ELSE round(o_totalprice) END AS revenue,
  CASE WHEN o_orderkey % 50 = 1 THEN round(o_totalprice) * 1e8 WHEN o_orderkey % 31 = 2 THEN round(o_totalprice) * 20 WHEN o_orderkey % 7 <> 3 THEN round(o_totalprice) / 4 END AS ebitda,
  CASE WHEN o_orderkey % 50 = 1 THEN round(o_totalprice) * 1e9 WHEN o_orderkey % 50 = 2 THEN round(o_totalprice) END AS net_debt, round(o_totalprice) / 1000 AS multiple FROM orders)"""


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.repaired(_financials(spark, sf_dir))


REPAIRED = f"""WITH {_FINANCIALS}, a AS (SELECT code, id, revenue, multiple, CASE WHEN net_debt IS NOT NULL AND abs(ebitda) > 1e7 THEN ebitda / 1e8 ELSE ebitda END AS ebitda, CASE WHEN abs(net_debt) > 1e7 THEN net_debt / 1e8 ELSE net_debt END AS net_debt FROM f),
m AS (SELECT code, quantile_cont(abs(ebitda), 0.5) FILTER (abs(ebitda) < 1e7) AS me, quantile_cont(revenue, 0.5) FILTER (revenue > 0) AS mr FROM a GROUP BY 1),
b AS (SELECT a.code, id, revenue, multiple, net_debt, mr, CASE WHEN abs(ebitda) > 1e6 * me THEN ebitda / 1e8 ELSE ebitda END AS ebitda FROM a JOIN m ON a.code = m.code)
SELECT code, id, revenue, CASE WHEN revenue > 0 AND ebitda > revenue * 8 THEN NULL ELSE ebitda END AS ebitda, net_debt, CASE WHEN revenue > 0 AND ebitda > revenue * 8 THEN NULL ELSE multiple END AS multiple FROM b WHERE NOT coalesce(revenue > 0 AND revenue > 1e4 * mr, false)"""


def _stored_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored bars up to a day, fresh ones around it, and all of them as they would be loaded anew; every seventh code was split since."""
    bars = views.bars(spark, sf_dir).select("code", "bar_date", (F.floor(F.col("close") * 100) / 100).alias("close"))
    stored = bars.where("bar_date < date'1997-01-01' and code % 10 <> 4")
    split = bars.withColumn("close", F.when(F.col("code") % 7 == 0, F.col("close") / 2).otherwise(F.col("close")))
    return stored, split.where("bar_date between date'1996-06-01' and date'1997-06-30'"), split.where("bar_date >= date'1995-01-01'")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars after a load: merged, or loaded again where the past has changed."""
    out = ledger.merged_series(*_stored_fresh(spark, sf_dir))
    return out.groupBy("code").agg(F.count("*").alias("n"), F.min("bar_date").alias("first"), F.max("bar_date").alias("last"), F.round(F.sum(F.col("close").cast("decimal(18,4)")).cast("double"), 4).alias("total"))


_SPLIT = f"""{BARS}, b AS (SELECT code, bar_date, floor(close * 100) / 100 AS close FROM bars), st AS (SELECT * FROM b WHERE bar_date < DATE '1997-01-01' AND code % 10 <> 4),
sp AS (SELECT code, bar_date, CASE WHEN code % 7 = 0 THEN close / 2 ELSE close END AS close FROM b), fr AS (SELECT * FROM sp WHERE bar_date BETWEEN DATE '1996-06-01' AND DATE '1997-06-30'),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY bar_date DESC) AS k FROM st)"""
MERGED = f"""WITH {_SPLIT}, mv AS (SELECT k.code FROM k JOIN fr ON k.code = fr.code AND k.bar_date = fr.bar_date WHERE k = 2 AND abs(k.close - fr.close) > 0.01),
o AS (SELECT * FROM fr WHERE code NOT IN (SELECT code FROM mv) UNION ALL SELECT * FROM st WHERE code NOT IN (SELECT code FROM mv) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.code = st.code AND fr.bar_date = st.bar_date)
  UNION ALL SELECT * FROM sp WHERE bar_date >= DATE '1995-01-01' AND code IN (SELECT code FROM mv))
SELECT code, count(*) AS n, min(bar_date) AS first, max(bar_date) AS last, round(CAST(sum(CAST(close AS DECIMAL(18, 4))) AS DOUBLE), 4) AS total FROM o GROUP BY 1"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to fetch for each code, and whether a row made of its last bar is out of date."""
    stored, _, full = _stored_fresh(spark, sf_dir)
    codes = views.universe(spark, sf_dir).select("code")
    cache = stored.groupBy("code").agg(F.max("bar_date").alias("last"))
    old = ledger.changed_since(cache, full.where("code % 3 <> 0").unionByName(stored.where("code % 3 = 0"))).select("code", F.lit(True).alias("outdated"))
    return ledger.fetch_plan(codes, stored).join(old, "code", "left").select("code", "mode", "since", F.coalesce("outdated", F.lit(False)).alias("outdated"))


PLAN = f"""WITH {_SPLIT}, {UNIVERSE}, s AS (SELECT code, min(bar_date) - 3 AS since FROM k WHERE k <= 2 GROUP BY 1), c AS (SELECT code, max(bar_date) AS last FROM st GROUP BY 1),
n AS (SELECT code, max(bar_date) AS last FROM (SELECT * FROM sp WHERE bar_date >= DATE '1995-01-01' AND code % 3 <> 0 UNION ALL SELECT * FROM st WHERE code % 3 = 0) GROUP BY 1)
SELECT u.code, CASE WHEN since IS NULL THEN 'seed' ELSE 'incremental' END AS mode, CAST(since AS DATE) AS since, n.code IS NOT NULL AND c.last IS DISTINCT FROM n.last AS outdated FROM universe u LEFT JOIN s ON u.code = s.code LEFT JOIN c ON u.code = c.code LEFT JOIN n ON u.code = n.code"""


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from a day on and their lines, after status updates of a batch and a reload of some customers."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    orders = o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    batch = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("status")).unionByName(spark.createDataFrame([(-1, "X")], "o_orderkey long, status string"))
    orders = ledger.updated(orders, batch, ["o_orderkey"])
    fresh = orders.where("o_custkey % 11 = 0 and status <> 'F'").withColumn("status", F.lit("R"))
    kept, lines = _retain(ledger.replaced(orders, fresh, "o_custkey"), l)
    return kept.groupBy("status").agg(F.count("*").alias("orders")).join(lines.groupBy("status").agg(F.count("*").alias("lines")), "status", "left")


def _retain(orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept, left = ledger.retained(orders.withColumnRenamed("o_orderkey", "key"), lines.withColumnRenamed("l_orderkey", "key"), "key", "day", F.lit("1996-01-01").cast("date"))
    return kept, left.join(kept.select("key", "status"), "key")


RETAINED = """WITH a AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders),
r AS (SELECT DISTINCT o_custkey FROM a WHERE o_custkey % 11 = 0 AND status <> 'F'), b AS (SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM r) UNION ALL SELECT o_orderkey, o_custkey, day, 'R' FROM a WHERE o_custkey % 11 = 0 AND status <> 'F'),
k AS (SELECT * FROM b WHERE day >= DATE '1996-01-01'), l AS (SELECT status, count(*) AS lines FROM k JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT status, count(*) AS orders, any_value(lines) AS lines FROM k LEFT JOIN l USING (status) GROUP BY 1"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute quotes of users' events: kinds, how many minutes, and which kinds are out of date at the end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("kind"), "ts", "value", F.col("event_id").alias("ord"))
    q = ledger.minute_quotes(e.where("kind <> 'view' or ts < timestamp_ntz'2024-01-10 00:00:00'"))
    end = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    stale = ledger.staleness(q.where(F.col("minute") < end), ["click", "error", "purchase", "view", "never"], end, 86400)
    return stale.join(q.groupBy("kind").agg(F.count("*").alias("minutes"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("total")), "kind", "left").select("kind", "stale", "minutes", "total")


QUOTES = """WITH e AS (SELECT user_id AS name, event_type AS kind, ts, value, event_id AS ord FROM events WHERE event_type <> 'view' OR ts < TIMESTAMP '2024-01-10'),
q AS (SELECT name, date_trunc('minute', ts) AS minute, last(kind ORDER BY ts, ord) AS kind, last(value ORDER BY ts, ord) AS value FROM e GROUP BY 1, 2),
k AS (SELECT unnest(['click', 'error', 'purchase', 'view', 'never']) AS kind), n AS (SELECT kind, max(minute) AS newest FROM q WHERE minute < TIMESTAMP '2024-01-15' GROUP BY 1), t AS (SELECT kind, count(*) AS minutes, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 2) AS total FROM q GROUP BY 1)
SELECT k.kind, coalesce(TIMESTAMP '2024-01-15' - newest >= INTERVAL 86400 SECOND, true) AS stale, minutes, total FROM k LEFT JOIN n ON k.kind = n.kind LEFT JOIN t ON k.kind = t.kind"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's last event as a run of a job, its failures in the last days, and how often errors came by cause."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return ledger.latest_runs(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


RUNS = """SELECT 'job-' || user_id AS job, max(ts) AS last, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END, ts) AS status, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND event_type = 'error') AS failures FROM events GROUP BY 1"""


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by cause, most first, with their place."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").cast("int").alias("cause")).agg(F.count("*").alias("n"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "cause")))  # a row a cause


ERROR_COUNTS = "SELECT *, row_number() OVER (ORDER BY n DESC, cause) AS place FROM (SELECT CAST(json_extract(props, '$.k') AS INT) AS cause, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)"


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of each user by kind, three kinds at most, and the days since the one before."""
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05 00:00:00'").select(F.col("user_id").alias("code"), F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("ord"))
    return ledger.latest_events(e, 3)


RECENT_EVENTS = """WITH e AS (SELECT user_id AS code, event_type AS kind, CAST(ts AS DATE) AS day, event_type || ' ' || event_id AS text, event_id AS ord FROM events WHERE ts >= TIMESTAMP '2024-01-05'),
k AS (SELECT *, row_number() OVER (PARTITION BY code, kind ORDER BY day DESC, ord) AS n FROM e), p AS (SELECT code, kind, day, text, row_number() OVER (PARTITION BY code ORDER BY day DESC, kind) AS place FROM k WHERE n = 1) SELECT * FROM p WHERE place <= 3"""


def capped_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest 15 orders, newest first."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 15")


CAPPED_NEWEST = "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 15"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents as news: the first of equal ones, without links that are stored."""
    d = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.concat(F.lit("n/"), (F.col("doc_id") % 1000).cast("string")).alias("link"), F.col("doc_id").alias("ord"))
    stored = d.where("ord % 3 = 0").select("link")
    return ledger.new_items(d.where("ord % 3 <> 0"), stored).select("link", "ord", F.length("title").alias("chars"))


NEWS = r"""WITH d AS (SELECT regexp_extract(text, '^[^\n]*', 0) AS title, 'n/' || (doc_id % 1000) AS link, doc_id AS ord FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ord) AS n FROM d WHERE ord % 3 <> 0)
SELECT link, ord, length(title) AS chars FROM k WHERE n = 1 AND link NOT IN (SELECT link FROM d WHERE ord % 3 = 0)"""


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership of nations by their customers: stakes, floating ratio, dilution and classes."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("code"), F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") % 100).cast("double") / 64).alias("stake")).where("code % 5 <> 0 or stake < 1")
    n = F.count("*")
    shares = c.groupBy(F.col("c_nationkey").alias("code")).agg((n * 100).alias("issued"), F.when(F.col("code") % 3 != 0, n * 7 * (F.col("code") % 9 + 1)).alias("treasury"), (n * (F.col("code") % 4)).alias("new"))
    return ledger.stakes(rows, shares)


HOLDERS = """WITH s AS (SELECT c_nationkey AS code, count(*) * 100 AS issued, CASE WHEN c_nationkey % 3 <> 0 THEN count(*) * 7 * (c_nationkey % 9 + 1) END AS treasury, count(*) * (c_nationkey % 4) AS new FROM customer GROUP BY 1),
h AS (SELECT c_nationkey AS code, sum(CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 100)::DOUBLE / 64 END) AS total FROM customer WHERE c_nationkey % 5 <> 0 OR (c_custkey % 6 <> 0 AND c_custkey % 100 < 64) GROUP BY 1),
o AS (SELECT s.code, round((issued - coalesce(treasury, 0)) / issued * 100, 2) AS floating, CASE WHEN new > 0 AND issued - coalesce(treasury, 0) > 0 THEN round(new / (issued - coalesce(treasury, 0)) * 100, 2) END AS dilution, CASE WHEN total > 0 THEN round(total, 2) END AS group_stake FROM s LEFT JOIN h ON s.code = h.code)
SELECT *, CASE WHEN group_stake >= 50 THEN 'dominant' WHEN group_stake >= 30 THEN 'stable' WHEN group_stake IS NOT NULL THEN 'dispersed' END AS group_class, CASE WHEN floating >= 60 THEN 'wide' WHEN floating >= 30 THEN 'fair' WHEN floating IS NOT NULL THEN 'tight' END AS floating_class FROM o"""

WORDS = ["machinery", "building"]


def subsidiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subsidiaries of their nation: tags, and which are shown."""
    c = table(spark, sf_dir, "customer")
    tags = ledger.significance(F.col("c_acctbal"), F.col("parent"), F.col("c_mktsegment"), WORDS)
    rows = c.withColumn("parent", F.when(F.col("c_nationkey") % 4 != 0, 20000.0 + 5000 * F.col("c_nationkey"))).select("c_custkey", tags.alias("tags"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 12).cast("double")).alias("stake"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 13) * 100_000_000).alias("book"))
    return rows.where(ledger.shown_subsidiary(F.col("tags"), F.col("stake"), F.col("book"))).select(F.col("c_custkey").alias("id"), F.array_join("tags", ",").alias("tags"))


SUBSIDIARIES = """WITH r AS (SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_nationkey % 4 <> 0 AND c_acctbal >= (20000 + 5000 * c_nationkey) * 0.1::DOUBLE THEN 'profit' END, CASE WHEN c_acctbal < 0 THEN 'loss' END, CASE WHEN lower(c_mktsegment) LIKE '%machinery%' OR lower(c_mktsegment) LIKE '%building%' THEN 'new business' END) AS tags,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 12 END AS stake, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 13) * 100000000 END AS book FROM customer) SELECT id, tags FROM r WHERE tags <> '' OR coalesce(stake >= 5, false) OR coalesce(book >= 1000000000, false)"""


def holder_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders of suppliers among their orders' customers: the best stake of each, those that left within a year, and reporters in no list."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sold = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("code"), (F.col("o_custkey") % 50).alias("name"), F.to_date("o_orderdate").alias("day"), "l_quantity", F.col("l_orderkey").alias("ord"), "l_linenumber")
    rows = sold.where("day < date'1997-01-01' and name % 4 <> 1").select("code", "name", (F.col("l_quantity") - 10).alias("stake"), (F.col("ord") * 10 + F.col("l_linenumber")).alias("ord"))
    changes = sold.where("day >= date'1997-01-01'").select("code", "name", "day", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("after"))
    best, gone = ledger.holder_snapshot(rows, changes, F.lit("1998-08-01").cast("date"))
    lone = ledger.orphans(changes, best, gone)
    kinds = [best.select("code", "name", F.lit("held").alias("list"), F.lit(None).cast("date").alias("day")), gone.select("code", "name", F.lit("left").alias("list"), "day"), lone.select("code", "name", F.lit("other").alias("list"), "day")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


HOLDER_LISTS = """WITH s AS (SELECT l_suppkey AS code, o_custkey % 50 AS name, CAST(o_orderdate AS DATE) AS day, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
best AS (SELECT DISTINCT code, name FROM s WHERE day < DATE '1997-01-01' AND name % 4 <> 1 AND q > 10), c AS (SELECT code, name, day, q > 25 AS holds FROM s WHERE day >= DATE '1997-01-01'),
gone AS (SELECT code, name, max(day) AS day FROM c WHERE NOT holds AND DATE '1998-08-01' - day <= 365 AND (code, name) NOT IN (SELECT (code, name) FROM best) GROUP BY 1, 2),
lone AS (SELECT code, name, max(day) AS day FROM c WHERE (code, name) NOT IN (SELECT (code, name) FROM best) AND (code, name) NOT IN (SELECT (code, name) FROM gone) GROUP BY 1, 2)
SELECT code, name, 'held' AS list, NULL::DATE AS day FROM best UNION ALL SELECT code, name, 'left', day FROM gone UNION ALL SELECT code, name, 'other', day FROM lone"""


def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and brands across the bridge of order lines, later than a cut-off of each customer: distinct suppliers and codes of orders' arrays."""
    o, l, c, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    begin = o.groupBy(F.col("o_custkey").alias("who")).agg(F.min("o_orderdate").alias("since"))
    late = o.join(begin, (F.col("o_custkey") == F.col("who")) & (F.col("o_orderdate") >= F.col("since") + F.expr("interval 365 days"))).select("o_orderkey", "o_custkey")
    rows = l.join(late, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("brand")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("n"))


BRIDGED = """WITH b AS (SELECT o_custkey AS who, min(o_orderdate) AS since FROM orders GROUP BY 1) SELECT c_mktsegment AS segment, p_brand AS brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) AS customers, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN b ON o_custkey = who AND o_orderdate >= since + INTERVAL 365 DAY JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as broadcasts that name suppliers: by sector how many name one, and how many of those also name supplier 5."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("codes"))  # a few lines an order
    named = l.select("l_orderkey", F.array_contains("codes", 5).alias("five"), F.explode("codes").alias("code")).join(views.universe(spark, sf_dir).select("code", "sector"), "code")
    return named.groupBy("sector").agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("mentions"), F.count_if("five").alias("with_five"))


ARRAYS = f"""WITH {UNIVERSE}, m AS (SELECT DISTINCT l_orderkey, l_suppkey AS code FROM lineitem), f AS (SELECT l_orderkey FROM m WHERE code = 5)
SELECT sector, count(DISTINCT l_orderkey) AS orders, count(*) AS mentions, count(*) FILTER (l_orderkey IN (SELECT l_orderkey FROM f)) AS with_five FROM m JOIN universe USING (code) GROUP BY 1"""


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded periods between two, whether they end a year, and whether they lie before a day."""
    o = table(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy.MM")).where(F.col("period").between("1993.11", "1997.02"))
    return o.groupBy("period").agg(F.count("*").alias("n")).select("period", "n", F.endswith("period", F.lit(".12")).alias("annual"), F.when(F.col("period") < "1996.01", "past").otherwise("ahead").alias("side"))


PERIODS = """SELECT strftime(o_orderdate, '%Y.%m') AS period, count(*) AS n, strftime(o_orderdate, '%Y.%m') LIKE '%.12' AS annual, CASE WHEN strftime(o_orderdate, '%Y.%m') < '1996.01' THEN 'past' ELSE 'ahead' END AS side FROM orders WHERE strftime(o_orderdate, '%Y.%m') BETWEEN '1993.11' AND '1997.02' GROUP BY ALL"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by phase of the day, over days with trades."""
    e = table(spark, sf_dir, "events")
    days = e.where("event_type = 'purchase'").select(F.to_date("ts").alias("day")).distinct()
    return e.withColumn("day", F.to_date("ts")).join(days, "day", "left_semi").groupBy(texts.market_phase(F.col("ts")).alias("phase")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


PHASES = """SELECT CASE WHEN hour(ts) >= 16 THEN 'closing' WHEN hour(ts) * 60 + minute(ts) >= 540 THEN 'intraday' ELSE 'forecast' END AS phase, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase') GROUP BY 1"""

GOOD, BAD = ["the", "contract", "order", "la"], ["not", "risk", "und"]


def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are about a word, with the keywords of two sides that they hold, best first within a source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    kept = d.where(texts.is_subject(F.lit("and"), title, F.col("text"))).withColumns({"good": F.array_join(texts.hits(F.col("text"), GOOD), ","), "bad": F.array_join(texts.hits(F.col("text"), BAD), ",")})
    score = F.size(texts.hits(F.col("text"), GOOD)) + F.size(texts.hits(F.col("text"), BAD))
    return kept.select("doc_id", "source", "good", "bad", score.alias("score"), texts.mentions(F.col("text"), F.lit("and")).alias("mentions"))


_HITS = lambda words: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL), ',')"
_COUNT = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in GOOD + BAD)
EVENT_SEARCH = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), m AS (SELECT *, CAST((length(text) - length(replace(text, 'and', ''))) / 3 AS INT) AS mentions FROM d)
SELECT doc_id, source, {_HITS(GOOD)} AS good, {_HITS(BAD)} AS bad, {_COUNT} AS score, mentions FROM m WHERE contains(regexp_replace(regexp_extract(text, '^[^\n]*', 0), '\s+', '', 'g'), 'and') OR mentions >= 3"""


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by an entity or, without one, their id, in the order in which groups are first seen."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.coalesce(F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", "source", (F.col("doc_id") % 8).cast("string"))), F.col("doc_id").cast("string"))).alias("entity"))
    groups = d.groupBy("entity").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # first seen first: ascending by the first document, which is the group's place
    return groups.select("entity", "first", "n", texts.longest_keyword(F.col("entity"), {"web": "W", "web/1": "W1", "/1": "ONE", "b": "B"}).alias("kind"))


ENTITY_GROUPS = """WITH d AS (SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 5 <> 0 THEN concat_ws('/', source, doc_id % 8) END, CAST(doc_id AS VARCHAR))) AS entity FROM documents)
SELECT entity, min(doc_id) AS first, count(*) AS n, CASE WHEN contains(lower(entity), 'web/1') THEN 'W1' WHEN contains(lower(entity), 'web') THEN 'W' WHEN contains(entity, '/1') THEN 'ONE' WHEN contains(lower(entity), 'b') THEN 'B' END AS kind FROM d GROUP BY 1"""


def peers_of_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's industry: its peers, and the largest of them but itself."""
    u = views.universe(spark, sf_dir)
    tops = u.withColumn("k", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("cap"), "code"))).where("k <= 2").groupBy("sector").agg(F.max(F.when(F.col("k") == 1, F.col("code"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("code"))).alias("two"))
    sizes = u.groupBy("sector").agg((F.count("*") - 1).alias("peers"))
    return u.join(tops, "sector").join(sizes, "sector").select("code", "peers", F.when(F.col("code") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("largest"))


PEERS_OF_INDUSTRY = f"""WITH {UNIVERSE}, t AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cap DESC, code) AS k FROM universe)
SELECT u.code, (SELECT count(*) FROM universe v WHERE v.sector = u.sector) - 1 AS peers, (SELECT t.code FROM t WHERE t.sector = u.sector AND t.code <> u.code ORDER BY k LIMIT 1) AS largest FROM universe u"""


def calendar_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from the first close of the last 90 days to the last, for codes with 40 bars in the last 150 days of the tables."""
    bars = views.bars(spark, sf_dir).select("code", "bar_date", "close")
    end = F.lit("1998-08-01").cast("date")
    recent = bars.where((F.datediff(end, "bar_date") <= 1500) & (F.col("bar_date") <= end))
    inside = F.datediff(end, "bar_date") <= 900
    got = recent.groupBy("code").agg(F.count("*").alias("n"), F.max_by("close", "bar_date").alias("last"), F.min_by("close", F.when(inside, F.col("bar_date"))).alias("past"), F.min_by("close", "bar_date").alias("oldest"))
    past = F.coalesce("past", "oldest")
    return got.where("n >= 40").select("code", "n", F.round(F.when(past > 0, (F.col("last") - past) / past * 100), 2).alias("momentum"))


CALENDAR_MOMENTUM = f"""WITH {BARS}, r AS (SELECT * FROM bars WHERE DATE '1998-08-01' - bar_date <= 1500 AND bar_date <= DATE '1998-08-01'),
g AS (SELECT code, count(*) AS n, arg_max(close, bar_date) AS last, coalesce(arg_min(close, bar_date) FILTER (DATE '1998-08-01' - bar_date <= 900), arg_min(close, bar_date)) AS past FROM r GROUP BY 1) SELECT code, n, round((last - past) / past * 100, 2) + 0.0 AS momentum FROM g WHERE n >= 40"""


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of documents, their parts for messages, and whether a title reviews the home market's close."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = d.select("doc_id", texts.snippet(F.col("text")).alias("snippet"), texts.pieces(F.col("text"), 1000).alias("parts"), texts.domestic_closing(F.regexp_extract("text", r"^[^\n]*", 0)).alias("closing"))
    return found.select("doc_id", "snippet", F.size("parts").alias("parts"), F.aggregate("parts", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"), "closing")


QUERIES = {
    "t8_repaired": repaired,
    "t9_merged_series": merged,
    "t10_t17_fetch_plan": plan,
    "t6_t7_m15_retained": retained,
    "t14_minute_quotes": quotes,
    "m7_latest_runs": runs,
    "a26_error_counts": error_counts,
    "o8_recent_events": recent_events,
    "o9_capped_newest": capped_newest,
    "t19_news": news,
    "a18_f31_stakes": holders,
    "m9_subsidiaries": subsidiaries,
    "m11_m12_holder_lists": holder_lists,
    "j5_j7_bridged": bridged,
    "p8_j22_arrays": arrays,
    "p10_p11_p19_periods": periods,
    "m4_m5_phases": phases,
    "q20_p21_event_search": event_search,
    "u6_g12_entity_groups": entity_groups,
    "j19_industry_peers": peers_of_industry,
    "w6_calendar_momentum": calendar_momentum,
    "f41_f42_previews": previews,
}
ORACLES = {
    "t8_repaired": REPAIRED,
    "t9_merged_series": MERGED,
    "t10_t17_fetch_plan": PLAN,
    "t6_t7_m15_retained": RETAINED,
    "t14_minute_quotes": QUOTES,
    "m7_latest_runs": RUNS,
    "a26_error_counts": ERROR_COUNTS,
    "o8_recent_events": RECENT_EVENTS,
    "o9_capped_newest": CAPPED_NEWEST,
    "t19_news": NEWS,
    "a18_f31_stakes": HOLDERS,
    "m9_subsidiaries": SUBSIDIARIES,
    "m11_m12_holder_lists": HOLDER_LISTS,
    "j5_j7_bridged": BRIDGED,
    "p8_j22_arrays": ARRAYS,
    "p10_p11_p19_periods": PERIODS,
    "m4_m5_phases": PHASES,
    "q20_p21_event_search": EVENT_SEARCH,
    "u6_g12_entity_groups": ENTITY_GROUPS,
    "j19_industry_peers": PEERS_OF_INDUSTRY,
    "w6_calendar_momentum": CALENDAR_MOMENTUM,
}
