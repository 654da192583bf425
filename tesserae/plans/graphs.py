"""Queries over the company graph, names, vectors and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import graphs
from tesserae.operators import mentions as mentions_
from tesserae.operators import nearest as nearest_
from tesserae.operators.shared import shared_dir
from tesserae.sources import views
from tesserae.sources.views import EDGES, UNIVERSE, table


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.concentration(views.edges(spark, sf_dir)).withColumn("hhi", F.round("hhi", 4))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir)
    return graphs.product_peers(e, e.where("src % 50 = 0").select("src").distinct())


def explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir).withColumn("dst", F.col("dst") + 1_000_000)
    nodes = e.where("src = 3").select(F.col("src").alias("node")).union(e.where("dst in (1000001, 1000002)").select(F.col("dst").alias("node"))).distinct()
    return graphs.neighbours(e, nodes).withColumn("share", F.round("share", 6))


def industry_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the latest figures of an industry's members."""
    u, e = views.universe(spark, sf_dir), graphs.concentration(views.edges(spark, sf_dir))
    return u.join(e, u.code == e.src, "left").groupBy("sector").agg(F.round(F.avg("hhi"), 4).alias("hhi"), F.round(F.avg("cap"), 4).alias("cap"), F.count("*").alias("n"))


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as canon; mentions by id, with marks, reordered, and unknown."""
    p = table(spark, sf_dir, "part")
    canon = p.select(F.col("p_partkey").alias("c_id"), F.concat("p_name", F.lit(" n"), F.col("p_partkey")).alias("c_name"))
    k, n = F.col("c_id"), F.col("c_name")
    name = F.when(k % 4 == 1, F.concat(F.upper(n), F.lit(" (Korea) Inc."))).when(k % 4 == 2, F.array_join(F.reverse(F.split(n, " ")), " ")).when(k % 4 == 3, F.concat(F.lit("zz"), k.cast("string"))).otherwise(n)
    m = canon.select(k.alias("m_id"), name.alias("name"), F.when(k % 4 == 0, k).alias("hint_id"))
    return graphs.resolve(m, canon)


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = names.where("id % 50 = 0").select(F.concat(F.col("name"), F.lit("x")).alias("q")).distinct()
    return nearest_.fuzzy_top(names, asked).select("q", "id", "rank", F.round("score", 6).alias("score"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest_.nearest_by_cosine(e, e.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))).withColumn("score", F.round("score", 6))


NEAREST = """WITH s AS (SELECT q.vec_id AS q, b.vec_id AS id, list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings b JOIN embeddings q ON q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id)
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 5"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("t_id"), "text")
    names = spark.createDataFrame([(1, "the"), (2, "that"), (3, "zzz"), (4, "from")], "code int, word string")
    return graphs.mentions(t, names).groupBy("code").agg(F.count("*").alias("n"))


MENTIONS = "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS w FROM documents), n(code, word) AS (VALUES (1, 'the'), (2, 'that'), (3, 'zzz'), (4, 'from')) SELECT CAST(code AS INTEGER) AS code, count(*) AS n FROM w JOIN n ON w = word GROUP BY 1"


def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name: the first words of the document with a supplier's key: one, two or three."""
    opening = F.regexp_extract("text", "([A-Za-z]{4,}) ([A-Za-z]+) ([A-Za-z]+)", 0)
    d = table(spark, sf_dir, "documents").select("doc_id", opening.alias("opening"))  # a join that deals has no texts to deal
    words = F.slice(F.split("opening", " "), 1, F.col("s_suppkey").cast("int") % 3 + 1)
    return table(spark, sf_dir, "supplier").join(d, F.col("s_suppkey") == F.col("doc_id")).select(F.col("s_suppkey").alias("code"), F.array_join(words, " ").alias("name"))


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("t_id"), "text")


def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers in all documents."""
    return mentions_.mentions(texts_of(spark, sf_dir), supplier_names(spark, sf_dir))


MENTIONED_NAMES = """WITH n AS (SELECT s_suppkey AS code, array_to_string(list_slice(string_split(regexp_extract(text, '([A-Za-z]{4,}) ([A-Za-z]+) ([A-Za-z]+)', 0), ' '), 1, s_suppkey % 3 + 1), ' ') AS name FROM supplier JOIN documents ON s_suppkey = doc_id),
w AS (SELECT DISTINCT name FROM n WHERE trim(name) <> ''),
p AS (SELECT a.name, b.name AS other FROM w a JOIN w b ON a.name <> b.name AND contains(b.name, a.name)),
u AS (SELECT w.name, coalesce(list(other ORDER BY length(other) DESC, other) FILTER (other IS NOT NULL), []) AS others FROM w LEFT JOIN p USING (name) GROUP BY 1 HAVING count(other) < 4)
SELECT DISTINCT doc_id AS t_id, code FROM documents JOIN u ON contains(text, u.name) JOIN n ON n.name = u.name
WHERE regexp_matches(list_reduce(list_prepend(text, others), lambda a, b: replace(a, b, ' ')), '(^|[^가-힣A-Za-z0-9])' || u.name || '([^가-힣A-Za-z0-9]|$)')"""


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = o.select((F.col("o_custkey") % 20).alias("company"), F.col("o_custkey").alias("holder"), F.struct("o_orderdate", "o_orderkey").alias("day"), F.col("o_totalprice").alias("pct"))
    return graphs.holders(s)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every part depends on, where each depends on its half and its third."""
    shared_dir(spark)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    e = p.where("src > 1").select("src", F.explode(F.array_distinct(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3)))).alias("dst")).where("dst > 0")
    return graphs.closure(e, p.select(F.col("src").alias("node")))


CLOSURE = """WITH RECURSIVE p AS (SELECT p_partkey AS s FROM part), e AS (SELECT DISTINCT s, d FROM (SELECT s, s // 2 AS d FROM p WHERE s > 1 UNION ALL SELECT s, s // 3 FROM p WHERE s > 1) WHERE d > 0),
r AS (SELECT s AS root, s AS node FROM p UNION SELECT r.root, e.d FROM r JOIN e ON r.node = e.s) SELECT root, node FROM r WHERE root <> node"""

QUERIES = {
    "a17_concentration": concentration,
    "j18_product_peers": peers,
    "j17_explore": explore,
    "a16_industry_average": industry_average,
    "g11_resolution": resolution,
    "o11_fuzzy_names": fuzzy_names,
    "o10_nearest": nearest,
    "j21_mentions": mentions,
    "j21_p17_p18_named": mentioned_names,
    "m10_holders": holders,
    "g10_closure": closure,
}

ORACLES = {
    "a17_concentration": f"WITH {EDGES} SELECT src, round(sum(share * share), 4) AS hhi, count(*) AS n, CASE WHEN sum(share * share) < 1500 THEN 'low' WHEN sum(share * share) < 2500 THEN 'moderate' ELSE 'high' END AS band FROM edges GROUP BY 1",
    "j18_product_peers": f"WITH {EDGES} SELECT a.src, b.src AS peer, count(DISTINCT a.dst) AS shared FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src WHERE a.src % 50 = 0 GROUP BY 1, 2",
    "j17_explore": f"WITH {EDGES} SELECT src AS node, dst + 1000000 AS other, 'out' AS direction, round(share, 6) AS share FROM edges WHERE src = 3 UNION ALL SELECT dst + 1000000, src, 'in', round(share, 6) FROM edges WHERE dst IN (1, 2)",
    "a16_industry_average": f"WITH {EDGES}, {UNIVERSE}, h AS (SELECT src, sum(share * share) AS hhi FROM edges GROUP BY 1) SELECT sector, round(avg(hhi), 4) AS hhi, round(avg(cap), 4) AS cap, count(*) AS n FROM universe LEFT JOIN h ON code = src GROUP BY 1",
    "g11_resolution": "SELECT p_partkey AS m_id, CASE WHEN p_partkey % 4 <> 3 THEN p_partkey END AS found, CASE p_partkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'new' END AS how FROM part",
    "o10_nearest": NEAREST,
    "j21_mentions": MENTIONS,
    "j21_p17_p18_named": MENTIONED_NAMES,
    "m10_holders": "SELECT o_custkey % 20 AS company, o_custkey AS holder, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS first, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS latest, max(o_totalprice) AS best, count(*) AS reports FROM orders GROUP BY 1, 2",
    "g10_closure": CLOSURE,
}
