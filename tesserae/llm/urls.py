"""URL filter: exact rules first, then a character language-model ratio.

Two Markov models over URL characters, one of accepted and one of rejected
URLs, have contexts of variable length: up to ``ORDER`` characters, each order
smoothed into the next shorter one (Witten-Bell: the weight of the shorter
context is the number of different characters seen after the longer one).  A
URL's score is log P(rejected) - log P(accepted) per character, and it is
rejected above a threshold that a held-out quarter of the labelled URLs sets
(least mean of the two error rates; scores count as 5 nats at most there).

The labelled URLs are those that a rule decides.  Characters are the URL's own
(after ``://``, A-Z lower-cased), so the tables of counts have a row for each different
run of ``ORDER + 1`` characters and grow with the input.  They are summed before
any shuffle and joined by shuffle unless counted to be small.  Each different
URL is scored once.

Everything is DataFrame and SQL functions.

Rows: a null URL or one without ``://`` has an empty host and path; a null or
empty URL has no score and is allowed; repeated rows are judged alike; without
labelled URLs of both kinds the method allows everything; very long URLs are scored
whole; columns of the input named host, path, rule, verdict or score give way.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: (verdict, host, path); the longest that fits wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Characters of the longest context.
ORDER = 5
#: What stands before the first character, and the share of a character that was never seen.
_PAD = "\u0002"
_RARE = 1 / 1024
#: Thresholds tried: hundredths of a nat per character.
_STEPS = 500


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame) -> DataFrame:
    """urls with a row for each character: gram, the character after the ORDER before it."""
    shown = ascii_lower(F.regexp_replace("url", r"(?s)^.*?://", ""))
    chars = F.filter(F.split(F.concat(F.lit(_PAD * ORDER), shown), ""), lambda c: c != "")
    ends = F.when(F.length(shown) > 0, F.sequence(F.lit(1), F.length(shown))).otherwise(F.array().cast("array<int>"))
    return urls.withColumns({"_chars": chars, "_ends": ends}).withColumn("gram", F.explode(F.transform("_ends", lambda i: F.array_join(F.slice("_chars", i, ORDER + 1), "")))).drop("_chars", "_ends")


def fit(labelled: DataFrame, different: DataFrame) -> DataFrame:
    """labelled: url, rejected; different: url.  gram, ratio: the log ratio of each gram of the different URLs, whether labelled ones have it or not."""
    known = _grams(labelled.where(F.col("url").isNotNull() & F.col("rejected").isNotNull())).groupBy("gram").agg(F.count_if(F.col("rejected")).alias("n1"), F.count_if(~F.col("rejected")).alias("n0"))
    asked = _grams(different).groupBy("gram").agg(F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n0"))
    grams = common.cut(known.unionByName(asked).groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    lower = None
    for order in range(ORDER + 1):
        # the gram's last characters, and what stands before the last
        part = F.right("gram", F.lit(order + 1))
        counts = grams.groupBy(part.alias("gram")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        context = Window.partitionBy(F.left("gram", F.lit(order)))
        level = counts.select(
            "gram", "n1", "n0",
            *[F.sum(n).over(context).alias(f"all_{n}") for n in ("n1", "n0")],
            *[F.count_if(F.col(n) > 0).over(context).alias(f"kinds_{n}") for n in ("n1", "n0")],
        )
        if lower is None:
            level = level.withColumns({"low1": F.lit(_RARE), "low0": F.lit(_RARE)})
        else:
            level = level.withColumn("short", F.right("gram", F.lit(order))).join(lower, "short")

        def mixed(k: int) -> Column:
            n, total, kinds, low = F.col(f"n{k}"), F.col(f"all_n{k}"), F.col(f"kinds_n{k}"), F.col(f"low{k}")
            return F.when(total > 0, (n + kinds * low) / (total + kinds)).otherwise(low)

        level = level.select("gram", mixed(1).alias("p1"), mixed(0).alias("p0"))
        lower = level.select(F.col("gram").alias("short"), F.col("p1").alias("low1"), F.col("p0").alias("low0"))
    return level.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def score(different: DataFrame, model: DataFrame) -> DataFrame:
    """url, score of each different URL: log-likelihood difference per character, above zero where rejection is likelier."""
    return _grams(different).join(common.sized(model), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """scored: score, rejected.  One row with the threshold of least mean error."""
    step = F.greatest(F.lit(-_STEPS), F.least(F.lit(_STEPS), F.ceil(F.col("score") * 100))).cast("int")
    bins = scored.where("score is not null").groupBy(step.alias("step")).agg(F.count_if("rejected").alias("n1"), F.count_if(~F.col("rejected")).alias("n0"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over 1,001 bins at most
    everything = Window.partitionBy(F.lit(1))
    rates = bins.select(
        "step",
        F.try_divide(F.sum("n1").over(upto), F.sum("n1").over(everything)).alias("missed"),
        (1 - F.try_divide(F.sum("n0").over(upto), F.sum("n0").over(everything))).alias("wrong"),
    )
    error = F.round(F.coalesce("missed", F.lit(0.0)) + F.coalesce("wrong", F.lit(0.0)), 9)
    least = rates.select("step", error.alias("error")).groupBy("error").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    return least.agg(F.min_by((F.col("low") + F.col("high")) / 200.0, "error").alias("threshold"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], column: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score."""
    pages, back = common.apart(pages, (column,), ("host", "path", "rule", "verdict", "score"))
    url = F.col(column)
    host, path = split_url(url)
    ruled = pages.withColumns({"host": host, "path": path}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("_rule is not null").select(url.alias("url"), (F.col("_rule.verdict") == "block").alias("rejected"))
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    different = pages.select(url.alias("url")).where(F.length("url") > 0).distinct()
    model = common.cut(fit(labelled.where(~held), different))
    scored = common.cut(score(different, model))
    tuned = threshold(labelled.where(held).join(scored, "url"))
    both = labelled.agg(F.coalesce(F.bool_or("rejected") & F.bool_or(~F.col("rejected")), F.lit(False)).alias("both"))
    by_method = F.when(both.scalar() & (F.col("score") > F.coalesce(tuned.scalar(), F.lit(0.0))), "block").otherwise("allow")
    out = ruled.join(scored.withColumnRenamed("url", "__scored"), url == F.col("__scored"), "left").drop("__scored")
    return back(out.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", by_method)}).drop("_rule"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every URL of pages."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
