"""Relational queries: screener, coverage, rotation, joins, set operations, ingest merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.columns import all_of, band, clamp01, keyword_class, null_tolerant_least, weighted
from tesserae.operators import prices, relational
from tesserae.sources import views
from tesserae.sources.views import BARS, REPORTS, UNIVERSE, table

LABEL_SQL = "CASE sentiment WHEN 'BUY' THEN 1.0 WHEN 'HOLD' THEN 0.0 WHEN 'SELL' THEN -1.0 END"


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe with filters, coverage and technicals of the last bar; trend score, then pages of 50."""
    u = views.universe(spark, sf_dir)
    kept = u.where(all_of([null_tolerant_least(F.col("cap"), 500.0), F.col("market").isin("ASIA", "EUROPE", "AMERICA"), ~F.col("name").rlike("7$")]))
    last = relational.latest(prices.technicals(prices.last_bars(views.bars(spark, sf_dir))), ["code"], [F.desc("bar_date")])
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.countDistinct("l_orderkey").alias("coverage"))
    trend = weighted([
        (clamp01((F.col("near_high") - 0.7) / 0.3), 0.35),
        (F.when(F.col("aligned"), 1.0).when(F.col("aligned").isNotNull(), F.when(F.col("close") > F.col("ma120"), 0.5).otherwise(0.0)), 0.30),
        (band(F.col("volume_ratio"), 0.5, 2.0), 0.15),
        (band(F.col("return_60"), -20.0, 40.0), 0.20),
    ])
    joined = kept.join(last, "code", "left").join(orders, "code", "left").withColumn("trend_score", trend)
    page = joined.orderBy(F.coalesce("trend_score", F.lit(-1.0)).desc(), "code").limit(50)
    return page.select("code", "name", "market", "sector", F.coalesce("coverage", F.lit(0)).alias("coverage"), "trend_score")


SCREENER = f"""WITH {BARS}, {UNIVERSE}, m AS (
  SELECT *, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20,
    CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS ma60,
    CASE WHEN count(*) OVER (w ROWS 119 PRECEDING) = 120 THEN avg(close) OVER (w ROWS 119 PRECEDING) END AS ma120,
    close / max(high) OVER (w ROWS 251 PRECEDING) AS near_high, lag(close, 60) OVER w AS c60, lead(bar_date) OVER w AS nxt,
    CASE WHEN count(*) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) = 50 THEN avg(volume) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS usual
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY bar_date)),
p AS (SELECT code, greatest(0.0, least(1.0, (near_high - 0.7) / 0.3)) AS a,
    CASE WHEN ma20 IS NULL OR ma60 IS NULL OR ma120 IS NULL THEN NULL WHEN close > ma20 AND ma20 > ma60 AND ma60 > ma120 THEN 1.0 WHEN close > ma120 THEN 0.5 ELSE 0.0 END AS b,
    CASE WHEN usual > 0 THEN greatest(0.0, least(1.0, (volume / usual - 0.5) / 1.5)) END AS c,
    CASE WHEN c60 > 0 THEN greatest(0.0, least(1.0, (round((close / c60 - 1) * 100, 1) + 20) / 60)) END AS d FROM m WHERE nxt IS NULL),
o AS (SELECT l_suppkey AS code, count(DISTINCT l_orderkey) AS coverage FROM lineitem GROUP BY 1)
SELECT code, name, market, sector, coalesce(coverage, 0) AS coverage,
  round((coalesce(a * 0.35, 0) + coalesce(b * 0.30, 0) + coalesce(c * 0.15, 0) + coalesce(d * 0.20, 0)) /
    nullif((a IS NOT NULL)::INT * 0.35::DOUBLE + (b IS NOT NULL)::INT * 0.30::DOUBLE + (c IS NOT NULL)::INT * 0.15::DOUBLE + (d IS NOT NULL)::INT * 0.20::DOUBLE, 0) * 100, 1) AS trend_score
FROM universe LEFT JOIN p USING (code) LEFT JOIN o USING (code)
WHERE (cap IS NULL OR cap <= 0 OR cap >= 500) AND market IN ('ASIA', 'EUROPE', 'AMERICA') AND NOT regexp_matches(name, '7$')
ORDER BY coalesce(trend_score, -1) DESC, code LIMIT 50"""


def json_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [{"id": "size", "op": "gte", "value": 10}, {"id": "price", "op": "lt", "value": 1500}, {"id": "size", "op": "lte", "value": 40}]
    part = table(spark, sf_dir, "part")
    return part.where(relational.filters(spec, {"size": "p_size", "price": "p_retailprice"})).select("p_partkey", "p_size", "p_retailprice")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.coverage(views.reports(spark, sf_dir), ["industry", "market"]).withColumn("mean", F.round("mean", 6))


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.rotation(views.reports(spark, sf_dir), "industry").withColumn("mean", F.round("mean", 6))


def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reports(spark, sf_dir)
    per = r.groupBy("industry", "day").agg(F.avg(relational.sentiment_value(F.col("sentiment"))).alias("mean"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return per.select("industry", "day", F.round("mean", 6).alias("mean"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of each customer: urgent ones first, then the newest."""
    o = table(spark, sf_dir, "orders")
    best = relational.latest(o, ["o_custkey"], [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_orderdate"), F.desc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_orderpriority")


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest click value and the newest purchase value of each user, each on its own."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in ("click", "purchase", "view")])
    return relational.latest_each(e, "user_id", "at", ["click", "purchase", "view"])


def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order in 1997 and none in 1998."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    year = lambda y: o.where((F.year("o_orderdate") == y) & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(year(1997), "c_custkey", "left_semi").join(year(1998), "c_custkey", "left_anti").select("c_custkey", "c_name")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys sold by two suppliers, by only the first, by only the second."""
    l = table(spark, sf_dir, "lineitem")
    of = lambda s: l.where(F.col("l_suppkey") == s).select("l_partkey")
    name = lambda df, n: df.withColumn("kind", F.lit(n))
    a, b = of(1), of(2)
    return name(a.intersect(b), "both").unionByName(name(a.subtract(b), "first")).unionByName(name(b.subtract(a), "second"))


def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.group_median(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").withColumn("median", F.round("median", 4))


def top_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reports(spark, sf_dir)
    bonus = F.when(F.col("sentiment") == "BUY", 0.2).otherwise(0.0)
    return relational.top_per_group(r, "industry", "views", bonus, 5, "doc_id").select("industry", "doc_id", "rank", F.round("score", 6).alias("score"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and events of one normal form, the newest 200."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 180).cast("int")).cast("timestamp").alias("at"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"))
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), F.date_add(F.to_date(F.lit("2024-02-01")), (F.col("conv_id") % 90).cast("int")).cast("timestamp").alias("at"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"))
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("title"))
    return d.unionByName(c).unionByName(e).orderBy(F.desc("at"), "kind", "id").limit(200).select("kind", "id", "title")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by relevance (equal, prefix, part, other field), then size."""
    c, q = table(spark, sf_dir, "customer"), "customer#00000001"
    name = F.lower("c_name")
    rank = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).when(F.contains(name, F.lit("0001")), 2).when(F.ilike("c_mktsegment", F.lit("%auto%")), 3)
    return c.withColumn("relevance", rank).where("relevance is not null").orderBy("relevance", F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_name", "relevance")


RULES = [("brass", "metal"), ("steel", "metal"), ("red", "colour"), ("blue", "colour"), ("a", "other")]


def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", keyword_class(F.col("p_name"), RULES).alias("class"))


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select(F.col("source").alias("q"), F.col("doc_id").alias("idx"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int")).alias("day"))
    return relational.rerank(r, ["the", "and", "on in"]).select("q", "idx", "rel", "score")


def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return relational.fingerprint_rows(n, "n_regionkey", "n_nationkey", "n_name")


def propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of small sectors for each member supplier."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("theme"), F.col("s_suppkey").alias("code"))
    news = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 25).cast("int").alias("theme"))
    return relational.propagate(news, members, 4).select("event_id", "theme", "code")


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that still wait for a backfill, the next twenty."""
    codes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    return relational.pending(codes, codes.where("code % 3 = 0"), 20)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with two batches of corrections; the later one wins."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("value"))
    fresh = s.where("code % 2 = 0").select("code", (F.col("value") + 1).alias("value"), F.lit(1).cast("long").alias("seq")).union(s.where("code % 4 = 0").select("code", (F.col("value") + 2).alias("value"), F.lit(2).cast("long").alias("seq"))).union(s.where("code % 5 = 0").select(F.col("code") + 100000, "value", F.lit(3).cast("long").alias("seq")))
    return relational.upsert(s, fresh, ["code"], "seq")


def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value keeps what is stored, a cleared one doesn't."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("b"))
    clear = F.when(F.col("code") % 6 == 0, F.array(F.lit("b")))
    fresh = c.where("code % 2 = 0").select("code", F.when(F.col("code") % 4 == 0, F.col("a") * 2).alias("a"), F.lit(None).cast("string").alias("b"), clear.alias("clear"))
    return relational.partial_upsert(c, fresh, ["code"])


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and newest times of tables."""
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.max(c).cast("date").alias("newest")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars of event values for each event type."""
    e = table(spark, sf_dir, "events").select("event_type", "value", "ts", F.struct("ts", "event_id").alias("o"))
    bars = e.groupBy("event_type", F.window("ts", "30 minutes").alias("w")).agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").alias("n"))
    return bars.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "open", "high", "low", "close", "n")


def latest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("t"))
    return best.select("user_id", "t.event_id", "t.event_type", "t.value")


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parsed = e.select("event_type", F.from_json("props", "map<string,int>").alias("m")).where(F.map_contains_key("m", "k"))
    return parsed.groupBy("event_type").agg(F.sum(F.col("m")["k"]).alias("k"), F.count("*").alias("n"))


QUERIES = {
    "q1_screener": screener,
    "p12_json_filters": json_filters,
    "a1_a2_coverage": coverage,
    "q4_rotation": rotation,
    "a4_daily_sentiment": daily_sentiment,
    "a7_latest_order": latest_order,
    "a9_latest_metrics": latest_metrics,
    "j8_j9_anti_semi": anti_semi,
    "u3_set_operations": set_operations,
    "a12_group_median": median_by_group,
    "o5_top_reports": top_reports,
    "q11_timeline": timeline,
    "o6_search": search,
    "j15_keyword_rules": keyword_rules,
    "m2_rerank": rerank,
    "m8_row_fingerprints": row_fingerprints,
    "t12_propagation": propagation,
    "t11_resume": resume,
    "t1_t2_upsert": upsert,
    "t4_partial_upsert": partial_upsert,
    "a25_freshness": freshness,
    "a13_minute_bars": minute_bars,
    "t13_latest_ticks": latest_ticks,
    "p9_json_payload": json_payload,
}

_HITS = "SELECT source AS q, doc_id AS idx, regexp_extract(text, '^[^\n]*', 0) AS title, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS day FROM documents"

ORACLES = {
    "q1_screener": SCREENER,
    "p12_json_filters": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_retailprice < 1500 AND p_size <= 40",
    "a1_a2_coverage": f"WITH {REPORTS} SELECT industry, market, count(*) AS n, sum((sentiment = 'BUY')::INT) AS buys, round(avg({LABEL_SQL}), 6) AS mean FROM reports GROUP BY 1, 2",
    "q4_rotation": f"WITH {REPORTS}, c AS (SELECT industry, count(*) AS n, sum((sentiment = 'BUY')::INT) AS buys, avg({LABEL_SQL}) AS m FROM reports GROUP BY 1) SELECT industry, n, buys, round(m, 6) AS mean, round((0.7::DOUBLE * (m + 1) / 2 + 0.3::DOUBLE * n / max(n) OVER ()) * 100, 1) AS score FROM c",
    "a4_daily_sentiment": f"WITH {REPORTS} SELECT industry, day, round(avg({LABEL_SQL}), 6) AS mean, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM reports GROUP BY 1, 2",
    "a7_latest_order": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) = 1",
    "a9_latest_metrics": "SELECT user_id, " + ", ".join(f"last(value ORDER BY ts, event_id) FILTER (event_type = '{t}') AS {t}" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1",
    "j8_j9_anti_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998 AND o_orderpriority = '1-URGENT')",
    "u3_set_operations": "WITH a AS (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1), b AS (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2) SELECT *, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "a12_group_median": "SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1",
    "o5_top_reports": f"WITH {REPORTS}, s AS (SELECT *, coalesce(views::DOUBLE / nullif(max(views) OVER (PARTITION BY industry), 0), 0) + CASE WHEN sentiment = 'BUY' THEN 0.2::DOUBLE ELSE 0 END AS sc FROM reports), k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY sc DESC, doc_id) AS rank FROM s) SELECT industry, doc_id, rank, round(sc, 6) AS score FROM k WHERE rank <= 5",
    "q11_timeline": "WITH t AS (SELECT 'document' AS kind, doc_id AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 180 AS INTEGER) AS TIMESTAMP) AS moment, regexp_extract(text, '^[^\n]*', 0) AS title FROM documents UNION ALL SELECT 'conversation', conv_id, CAST(DATE '2024-02-01' + CAST(conv_id % 90 AS INTEGER) AS TIMESTAMP), regexp_extract(text, '^[^\n]*', 0) FROM conversations WHERE turn = 0 UNION ALL SELECT 'event', event_id, ts, event_type FROM events WHERE event_type = 'purchase') SELECT kind, id, title FROM t ORDER BY moment DESC, kind, id LIMIT 200",
    "o6_search": "WITH r AS (SELECT *, CASE WHEN lower(c_name) = 'customer#00000001' THEN 0 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 1 WHEN contains(lower(c_name), '0001') THEN 2 WHEN c_mktsegment ILIKE '%auto%' THEN 3 END AS relevance FROM customer) SELECT c_custkey, c_name, relevance FROM r WHERE relevance IS NOT NULL ORDER BY relevance, c_acctbal DESC, c_custkey LIMIT 100",
    "j15_keyword_rules": "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{n}'" for w, n in RULES) + " END AS class FROM part",
    "m2_rerank": f"WITH h AS ({_HITS}), r AS (SELECT *, contains(b, 'the')::INT + contains(b, 'and')::INT + contains(b, 'onin')::INT AS rel FROM (SELECT *, regexp_replace(lower(title), '\\s+', '', 'g') AS b FROM h)), k AS (SELECT * FROM r WHERE rel > 0 QUALIFY row_number() OVER (PARTITION BY q, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]', '', 'g') ORDER BY idx) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY q) AS n, dense_rank() OVER (PARTITION BY q ORDER BY day) AS age FROM k), x AS (SELECT *, max(age) OVER (PARTITION BY q) AS ages FROM p) SELECT q, idx, rel, round(0.7::DOUBLE * (1 - pos::DOUBLE / n) + 0.3::DOUBLE * CASE WHEN ages > 1 THEN (age - 1)::DOUBLE / (ages - 1) ELSE 0.5 END + 0.1::DOUBLE * (rel - 1), 6) AS score FROM x",
    "m8_row_fingerprints": "SELECT n_regionkey, left(sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey || '|' || n_name)), 16) AS fingerprint FROM nation GROUP BY 1",
    "t12_propagation": "WITH s AS (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) <= 4) SELECT event_id, s_nationkey AS theme, s_suppkey AS code FROM (SELECT event_id, CAST(user_id % 25 AS INTEGER) AS theme FROM events WHERE event_type = 'purchase') JOIN supplier ON theme = s_nationkey WHERE s_nationkey IN (FROM s)",
    "t11_resume": "SELECT s_suppkey AS code FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY 1 LIMIT 20",
    "t1_t2_upsert": "SELECT s_suppkey AS code, s_acctbal + CASE WHEN s_suppkey % 4 = 0 THEN 2 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS value FROM supplier UNION ALL SELECT s_suppkey + 100000, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0",
    "t4_partial_upsert": "SELECT c_custkey AS code, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS b FROM customer",
    "a25_freshness": "SELECT 'orders' AS name, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS newest FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(max(l_shipdate) AS DATE) FROM lineitem UNION ALL SELECT 'events', count(*), CAST(max(ts) AS DATE) FROM events",
    "a13_minute_bars": "SELECT event_type, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "t13_latest_ticks": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "p9_json_payload": "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS k, count(*) AS n FROM events WHERE json_exists(props, '$.k') GROUP BY 1",
}
