"""Entity resolution, company graph and text mentions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions.columns import name_words, token_jaccard
from tesserae.operators.shared import new_folder, stored


def concentration(edges: DataFrame) -> DataFrame:
    """Herfindahl index of each source's shares (percent) and its band."""
    h = F.sum(F.col("share") * F.col("share"))
    out = edges.groupBy("src").agg(h.alias("hhi"), F.count("*").alias("n"))
    return out.withColumn("band", F.when(F.col("hhi") < 1500, "low").when(F.col("hhi") < 2500, "moderate").otherwise("high"))


def product_peers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Other sources that share products with those of `of` (column src); one row a pair, with the number shared.

    The asked side is joined first, so only its products are expanded.
    """
    mine = edges.join(of, "src", "left_semi").select(F.col("src"), "dst")
    other = edges.select(F.col("src").alias("peer"), "dst")
    return mine.join(other, "dst").where("peer <> src").groupBy("src", "peer").agg(F.countDistinct("dst").alias("shared"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges at the given nodes (column node), seen from them, in both directions."""
    out = edges.join(nodes, F.col("src") == F.col("node")).select("node", F.col("dst").alias("other"), F.lit("out").alias("direction"), "share")
    into = edges.join(nodes, F.col("dst") == F.col("node")).select("node", F.col("src").alias("other"), F.lit("in").alias("direction"), "share")
    return out.unionByName(into)


#: So many nodes a row of the closure names at most: beyond, what a node depends on lies in several rows.
ROW_NODES = 1_000_000


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node) of everything that a root depends on, breadth first, until nothing new is found.

    What each node depends on goes up to those that depend on it, as arrays: the news of a round is joined with the edges where it lies,
    in buckets by node, and dealt once, by the node that it is news for; each round's news is written, not replayed.
    A node's array is split by its members' remainders, into as many rows as keep it bounded.
    All nodes' sets are worked out, whatever the roots are: for a few roots, cut the edges first.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"closure_{uuid.uuid4().hex}"

    def keep(df: DataFrame, what: str, by: str, *part: str) -> DataFrame:
        table = f"{name}_{what}"
        out = df.write.bucketBy(buckets, by).sortBy(by)
        out = out.partitionBy(*part) if part else out
        (out.mode("append") if spark.catalog.tableExists(table) else out.option("path", new_folder(spark, what))).saveAsTable(table)
        return spark.table(table)

    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    known = keep(pairs.repartition(buckets, "dst"), "edges", "dst")
    slices = known.select("dst").distinct().count() // ROW_NODES + 1
    first = known.repartition(buckets, "src").groupBy(F.col("src").alias("at"), F.pmod("dst", F.lit(slices)).cast("int").alias("slice")).agg(F.sort_array(F.collect_set("dst")).alias("nodes"))
    held, n = keep(first.withColumn("round", F.lit(0)), "news", "at", "round"), 0
    while not (news := held.where(F.col("round") == n)).isEmpty():
        came = known.join(news, known["dst"] == news["at"]).select(known["src"], "slice", "nodes").repartition(buckets, "src")
        came = came.groupBy(F.col("src").alias("at"), "slice").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("came"))
        seen = held.groupBy("at", "slice").agg(F.flatten(F.collect_list("nodes")).alias("seen"))
        new = came.join(seen, ["at", "slice"], "left").select("at", "slice", F.sort_array(F.array_except("came", F.coalesce("seen", F.array().cast("array<bigint>")))).alias("nodes"))
        n += 1
        held = keep(new.where(F.size("nodes") > 0).withColumn("round", F.lit(n)), "news", "at", "round")
    of = start.select(F.col("node").cast("long").alias("at"))
    return held.join(of, "at", "left_semi").select(F.col("at").alias("root"), F.explode("nodes").alias("node")).where("root <> node")


def name_key(c: Column) -> Column:
    """A company name without legal form, brackets, marks and white space."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)|주식회사|\b(inc|corp|co|ltd|llc|plc|company|corporation|limited)\b\.?", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")


def _rare_words(names: DataFrame, key: str, name: str, counts: DataFrame, threshold: float) -> DataFrame:
    """(key, word): the rarest words of a name, so many that two names of that similarity share one of them."""
    words = names.select(key, F.explode(name_words(F.col(name))).alias("w")).join(counts, "w", "left")
    ordered = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("ws"))  # the words of one name
    kept = F.slice("ws", 1, F.size("ws") - F.ceil(F.size("ws") * threshold - 1e-9).cast("int") + 1)
    return ordered.select(key, F.explode(kept).alias("x")).select(key, F.col("x.w").alias("w"))


def resolve(mentions: DataFrame, canon: DataFrame, threshold: float = 0.9) -> DataFrame:
    """mentions: m_id, name, hint_id.  canon: c_id, c_name.  By id, else equal key, else the most alike set of words, else new.

    Only what a stage leaves goes to the next; the fuzzy stage compares names that
    share one of their rarest words, which loses no pair as alike as the threshold
    and keeps frequent words from pairing a large part of the table.  What a stage finds and leaves is
    stored: no stage is run again for the next, and no task holds the joins of them all.
    """
    by_id = stored(mentions.join(canon.select(F.col("c_id").alias("hint_id"), F.col("c_id").alias("found")), "hint_id").select("m_id", "found", F.lit("id").alias("how")), "by-id")
    rest = stored(mentions.select("m_id", "name").join(by_id, "m_id", "left_anti"), "rest")
    keys = canon.withColumn("key", name_key(F.col("c_name"))).where("key <> ''").groupBy("key").agg(F.min("c_id").alias("found"))
    exact = stored(rest.withColumn("key", name_key(F.col("name"))).join(keys, "key").select("m_id", "found", F.lit("exact").alias("how")), "exact")
    rest = stored(rest.join(exact, "m_id", "left_anti"), "rest")
    counts = canon.select(F.explode(name_words(F.col("c_name"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = stored(_rare_words(rest, "m_id", "name", counts, threshold).join(_rare_words(canon, "c_id", "c_name", counts, threshold), "w").select("m_id", "c_id").distinct(), "pairs")
    alike = pairs.join(rest, "m_id").join(canon.select("c_id", "c_name"), "c_id").withColumn("score", token_jaccard(F.col("name"), F.col("c_name"))).where(F.col("score") >= threshold)
    first = F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc("score"), "c_id"))
    fuzzy = stored(alike.withColumn("rn", first).where("rn = 1").select("m_id", F.col("c_id").alias("found"), F.lit("fuzzy").alias("how")), "fuzzy")
    new = stored(rest.join(fuzzy, "m_id", "left_anti").select("m_id", F.lit(None).cast("long").alias("found"), F.lit("new").alias("how")), "new")
    return by_id.unionByName(exact).unionByName(fuzzy).unionByName(new)


def mentions(texts: DataFrame, names: DataFrame, confusable: DataFrame | None = None) -> DataFrame:
    """texts: t_id, text.  names: code, word (one word).  Texts that have the word between word boundaries.

    Texts are taken apart into words and joined, so no text meets every name.
    """
    words = texts.select("t_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("word"))
    wanted = names.select("code", F.lower("word").alias("word"))
    if confusable is not None:
        many = confusable.groupBy(F.lower("word").alias("word")).agg(F.countDistinct("other").alias("n")).where("n >= 4")
        wanted = wanted.join(many, "word", "left_anti")
    return words.join(wanted, "word").select("t_id", "code").distinct()


def holders(stakes: DataFrame) -> DataFrame:
    """stakes: company, holder, day, pct.  First and latest stake of each holder, and its best."""
    return stakes.groupBy("company", "holder").agg(F.min_by("pct", "day").alias("first"), F.max_by("pct", "day").alias("latest"), F.max("pct").alias("best"), F.count("*").alias("reports"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges: src, dst.  A symmetric relation, each pair once in either direction."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def related(edges: DataFrame, kind: str, at: str = "src") -> DataFrame:
    """edges: src, dst, kind.  (node, other) of one kind, seen from one end: customers from src, suppliers from dst."""
    other = "dst" if at == "src" else "src"
    return edges.where(F.col("kind") == kind).select(F.col(at).alias("node"), F.col(other).alias("other")).distinct()


def value_chain(edges: DataFrame, stages: DataFrame) -> DataFrame:
    """edges: src, dst; stages: node, stage.  How many neighbours of each node stand at each stage, and the first of them."""
    return edges.join(stages, F.col("dst") == F.col("node")).groupBy("src", "stage").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("first"))


def siblings(nodes: DataFrame, asked: DataFrame, digits: int = 6) -> DataFrame:
    """nodes: node, code.  (node, other) of asked nodes and others whose codes begin alike; the asked side is joined first."""
    part = lambda df, name: df.select(F.col("node").alias(name), F.left("code", F.lit(digits)).alias("_part"))
    mine = part(nodes.join(asked.select("node"), "node", "left_semi"), "node")
    return mine.join(part(nodes, "other"), "_part").where("node <> other").select("node", "other")


def review_queue(mentions: DataFrame, canon: DataFrame, rejected: DataFrame, least: int) -> DataFrame:
    """mentions: name.  Names that are neither known nor rejected, in one form each, with how often they came; rarer ones wait."""
    keyed = mentions.withColumn("key", name_key(F.col("name"))).where("key <> ''")
    known = canon.select(name_key(F.col("c_name")).alias("key")).union(rejected.select(name_key(F.col("name")).alias("key"))).distinct()
    return keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n")).where(F.col("n") >= least)


def edges_of_mentions(mentions: DataFrame, kinds: dict[str, str], otherwise: str) -> DataFrame:
    """mentions: src, dst, type, day.  One edge for each (src, dst, kind), from the newest mention; a type without a kind has the default."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("type")), F.lit(otherwise))
    return mentions.where("src <> dst").withColumn("kind", kind).groupBy("src", "dst", "kind").agg(F.max("day").alias("day"), F.count("*").alias("n"))
