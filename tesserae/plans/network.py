"""Queries over the network of companies: relations, industries, review of names, and reports on what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators import graphs, relational
from tesserae.sources import views
from tesserae.sources.views import UNIVERSE, table

KINDS = {"1-URGENT": "supplies", "2-HIGH": "supplies", "5-LOW": "competes"}


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers' nations that an order names together."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), (F.col("o_custkey") % 200).alias("dst"), F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("day"))


_MENTIONS = """m AS (SELECT l_suppkey AS src, o_custkey % 200 AS dst, o_orderpriority AS type, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT src, dst, CASE WHEN type IN ('1-URGENT', '2-HIGH') THEN 'supplies' WHEN type = '5-LOW' THEN 'competes' ELSE 'mentions' END AS kind, max(day) AS day, count(*) AS n FROM m WHERE src <> dst GROUP BY 1, 2, 3)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edges_of_mentions(_mentions(spark, sf_dir), KINDS, "mentions")


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


MENTION_EDGES = f"WITH {_MENTIONS} SELECT * FROM e"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's customers, suppliers and competitors, counted."""
    e = _edges(spark, sf_dir)
    sides = [("customers", graphs.related(e, "supplies")), ("suppliers", graphs.related(e, "supplies", "dst")), ("competitors", graphs.both_ways(e.where("kind = 'competes'")).select(F.col("src").alias("node"), F.col("dst").alias("other")))]
    out = [df.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("first")).withColumn("relation", F.lit(name)) for name, df in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


RELATIONS = f"""WITH {_MENTIONS}, c AS (SELECT src, dst FROM e WHERE kind = 'competes' UNION SELECT dst, src FROM e WHERE kind = 'competes')
SELECT src AS node, count(*) AS n, min(dst) AS first, 'customers' AS relation FROM e WHERE kind = 'supplies' GROUP BY 1 UNION ALL SELECT dst, count(*), min(src), 'suppliers' FROM e WHERE kind = 'supplies' GROUP BY 1 UNION ALL SELECT src, count(*), min(dst), 'competitors' FROM c GROUP BY 1"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's neighbours by their stage in the value chain."""
    stages = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("node"), F.concat(F.lit("stage "), (F.col("c_custkey") % 200 % 4).cast("string")).alias("stage")).distinct()
    return graphs.value_chain(_edges(spark, sf_dir).where("kind = 'supplies'"), stages)


CHAIN = f"WITH {_MENTIONS}, s AS (SELECT DISTINCT c_custkey % 200 AS node, 'stage ' || (c_custkey % 200 % 4) AS stage FROM customer) SELECT src, stage, count(DISTINCT dst) AS n, min(dst) AS first FROM e JOIN s ON dst = node WHERE kind = 'supplies' GROUP BY 1, 2"


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries of the same group as every fiftieth one, and the companies of each."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lpad((F.col("p_partkey") * 37).cast("string"), 8, "0").alias("code"))
    return graphs.siblings(nodes, nodes.where("node % 50 = 0"))


SIBLINGS = "WITH n AS (SELECT p_partkey AS node, left(lpad(CAST(p_partkey * 37 AS VARCHAR), 8, '0'), 6) AS part FROM part) SELECT a.node, b.node AS other FROM n a JOIN n b ON a.part = b.part AND a.node <> b.node WHERE a.node % 50 = 0"


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that customers' orders mention and that aren't known yet: those to review."""
    p = table(spark, sf_dir, "part")
    seen = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat("p_brand", F.when(F.col("l_linenumber") % 2 == 0, " Inc.").otherwise("")).alias("name"))
    canon = p.where("p_brand like '%1'").select(F.col("p_brand").alias("c_name")).distinct()
    rejected = p.where("p_brand like '%2'").select(F.concat("p_brand", F.lit(" Corp")).alias("name")).distinct()
    return graphs.review_queue(seen, canon, rejected, 20)


REVIEW = r"""WITH s AS (SELECT p_brand || CASE WHEN l_linenumber % 2 = 0 THEN ' Inc.' ELSE '' END AS name, regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g') AS key, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT key, min(name) AS name, count(*) AS n FROM s WHERE p_brand NOT LIKE '%1' AND p_brand NOT LIKE '%2' GROUP BY 1 HAVING count(*) >= 20"""


def sector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors by name or any of their aliases, and how many codes each finds; the longer alias wins."""
    alias = spark.createDataFrame([("nation", "OTHER"), ("nation_1", "TEENS"), ("nation_2", "TWENTIES"), ("_3", "THREE"), ("n_1", "ONE"), ("nation_12", "TWELVE")], "word string, found string")
    u = views.universe(spark, sf_dir)
    hits = u.join(F.broadcast(alias), F.contains(F.lower("sector"), F.col("word")))
    best = relational.latest(hits.select("code", "word", "found"), ["code"], [F.desc(F.length("word")), F.col("word")])
    return best.groupBy("found").agg(F.count("*").alias("n"), F.min("code").alias("first"))


SECTOR_CODES = f"""WITH {UNIVERSE}, a(word, found) AS (VALUES ('nation', 'OTHER'), ('nation_1', 'TEENS'), ('nation_2', 'TWENTIES'), ('_3', 'THREE'), ('n_1', 'ONE'), ('nation_12', 'TWELVE')),
h AS (SELECT code, found, row_number() OVER (PARTITION BY code ORDER BY length(word) DESC, word) AS k FROM universe JOIN a ON contains(lower(sector), word)) SELECT found, count(*) AS n, min(code) AS first FROM h WHERE k = 1 GROUP BY 1"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing by market: small companies, those without bars, and those whose bars ended."""
    u = views.universe(spark, sf_dir)
    last = views.bars(spark, sf_dir).groupBy("code").agg(F.max("bar_date").alias("last"), F.count("*").alias("bars"))
    small = F.percent_rank().over(Window.partitionBy("market").orderBy("cap"))  # one row a code
    rows = u.withColumn("small", small < 0.2).join(last, "code", "left")
    return rows.groupBy("market").agg(F.count("*").alias("codes"), F.count_if("small").alias("small"), F.count_if(F.col("bars").isNull()).alias("empty"), F.count_if(F.col("last") < F.lit("1998-09-01").cast("date")).alias("ended"), F.min("bars").alias("least"))


GAPS = f"""WITH {UNIVERSE}, {views.BARS}, l AS (SELECT code, max(bar_date) AS last, count(*) AS bars FROM bars GROUP BY 1), r AS (SELECT u.*, percent_rank() OVER (PARTITION BY market ORDER BY cap) < 0.2 AS small, last, bars FROM universe u LEFT JOIN l ON u.code = l.code)
SELECT market, count(*) AS codes, count(*) FILTER (small) AS small, count(*) FILTER (bars IS NULL) AS empty, count(*) FILTER (last < DATE '1998-09-01') AS ended, min(bars) AS least FROM r GROUP BY 1"""


QUERIES = {
    "m16_mention_edges": mention_edges,
    "g13_relations": relations,
    "g14_value_chain": chain,
    "g15_siblings": siblings,
    "g16_review_queue": review,
    "q14_sector_codes": sector_codes,
    "q21_q22_gaps": gaps,
}
ORACLES = {
    "m16_mention_edges": MENTION_EDGES,
    "g13_relations": RELATIONS,
    "g14_value_chain": CHAIN,
    "g15_siblings": SIBLINGS,
    "g16_review_queue": REVIEW,
    "q14_sector_codes": SECTOR_CODES,
    "q21_q22_gaps": GAPS,
}
