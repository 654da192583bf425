"""Relational services: coverage, rotation, latest-row choices, screener filters, timelines."""

from __future__ import annotations

import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SENTIMENT = {"BUY": 1.0, "HOLD": 0.0, "SELL": -1.0}
_OPS = {"gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt, "eq": operator.eq}


#: Parts that a group is ranked in first.
PARTS = 64


def sentiment_value(c: Column) -> Column:
    found = F.lit(None).cast("double")
    for name, v in SENTIMENT.items():
        found = F.when(c == name, v).otherwise(found)
    return found


def coverage(reports: DataFrame, by: list[str]) -> DataFrame:
    """Reports, buys and mean sentiment of each group."""
    return reports.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("sentiment") == "BUY", 1).otherwise(0)).alias("buys"), F.avg(sentiment_value(F.col("sentiment"))).alias("mean"))


def rotation(reports: DataFrame, by: str) -> DataFrame:
    """Rotation score: seven tenths mean sentiment, three tenths share of the busiest group's coverage."""
    c = coverage(reports, [by])
    top = F.max("n").over(Window.partitionBy(F.lit(1)))  # one row a group
    return c.withColumn("score", F.round((0.7 * (F.col("mean") + 1) / 2 + 0.3 * F.col("n") / top) * 100, 1))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order (DISTINCT ON)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_each(df: DataFrame, key: str, order: str, metrics: list[str]) -> DataFrame:
    """For each metric on its own the newest value that is there."""
    return df.groupBy(key).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in metrics])


def filters(spec: list[Mapping], allowed: Mapping[str, str]) -> Column:
    """A condition from filter objects {id, op, value}; unknown ids and operators are errors."""
    out = F.lit(True)
    for f in spec:
        if f.get("id") not in allowed:
            raise ValueError(f"unknown filter id {f.get('id')!r}")
        if f.get("op") not in _OPS:
            raise ValueError(f"unknown operator {f.get('op')!r}")
        out = out & F.coalesce(_OPS[f["op"]](F.col(allowed[f["id"]]), F.lit(float(f["value"]))), F.lit(False))
    return out


def top_per_group(df: DataFrame, group: str, value: str, bonus: Column, n: int, tie: str) -> DataFrame:
    """The n best of each group by value, normalised by the group's largest, plus a bonus.

    A group is cut to its n best in parts first, so no task holds a group.
    """
    most = df.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias("_most"))
    scored = df.join(most, F.col(group).eqNullSafe(F.col("_group"))).withColumn("score", F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_most")), F.lit(0.0)) + bonus).drop("_group", "_most")
    order = [F.desc("score"), F.col(tie)]
    part = F.pmod(F.xxhash64(tie), F.lit(PARTS))
    cut = scored.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).where(F.col("rank") <= n).drop("_part")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def group_median(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def rerank(hits: DataFrame, aliases: list[str], recency_weight: float = 0.3) -> DataFrame:
    """hits: q, idx, title, day.  Drop irrelevant ones, keep the first of equal titles, blend order, recency and relevance."""
    bare = F.regexp_replace(F.lower("title"), r"\s+", "")
    relevance = sum((F.contains(bare, F.lit(a.lower().replace(" ", ""))).cast("int") for a in aliases), F.lit(0))
    kept = hits.withColumn("rel", relevance).where("rel > 0").withColumn("key", F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}_]", ""))
    kept = latest(kept, ["q", "key"], [F.col("idx")]).drop("key")
    per = Window.partitionBy("q")
    at = F.row_number().over(per.orderBy("idx")) - 1
    kept = kept.withColumns({"pos": at, "n": F.count("*").over(per), "age": F.dense_rank().over(per.orderBy("day"))})
    kept = kept.withColumn("ages", F.max("age").over(per))
    recent = F.when(F.col("ages") > 1, (F.col("age") - 1) / (F.col("ages") - 1)).otherwise(0.5)
    score = (1 - recency_weight) * (1 - F.col("pos") / F.col("n")) + recency_weight * recent + 0.1 * (F.col("rel") - 1)
    return kept.withColumn("score", F.round(score, 6)).select("q", "idx", "title", "day", "rel", "score")


def fingerprint_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The first 16 hex digits of a group's ordered rows' digest."""
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return df.groupBy(key).agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256), F.lit(16)).alias("fingerprint"))


def propagate(news: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """Each news item of a theme for each member, themes with more than cap members left out."""
    small = members.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("theme")
    return news.join(members.join(small, "theme", "left_semi"), "theme")


def pending(codes: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Codes without a marker, in order, up to a budget."""
    rest = codes.join(done, "code", "left_anti").orderBy("code")
    return rest if limit is None else rest.limit(limit)


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key; of fresh rows with one key the last stays."""
    both = stored.withColumn("_new", F.lit(0)).withColumn("_ord", F.lit(0).cast("long")).unionByName(fresh.withColumnRenamed(ordinal, "_ord").withColumn("_new", F.lit(1)))
    return latest(both, key, [F.desc("_new"), F.desc("_ord")]).drop("_new", "_ord")


def partial_upsert(stored: DataFrame, fresh: DataFrame, key: list[str], clear: str = "clear") -> DataFrame:
    """A missing fresh value keeps the stored one, unless the column is named in the row's list of cleared columns."""
    values = [c for c in stored.columns if c not in key]
    new = fresh.select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.coalesce(F.col(clear), F.array().cast("array<string>")).alias("_clear"))
    both = stored.join(new, key, "full")
    return both.select(*key, *[F.when(F.array_contains("_clear", c), F.lit(None)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in values])


def monotone_least(old: Column, new: Column) -> Column:
    return F.least(F.coalesce(old, new), new)
