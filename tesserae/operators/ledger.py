"""What a store of series and events does on arrival: updates, repairs, reloads, water marks, quotes, runs, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators.relational import latest, upsert


def updated(stored: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """Columns of a computed batch replace those of the stored rows with its keys; other keys are left out."""
    values = [c for c in computed.columns if c not in key]
    new = computed.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in values])
    return stored.join(new, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns])


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Delete and reload: all rows of a key that arrives give way to the new ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def retained(parents: DataFrame, children: DataFrame, key: str, day: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Parents from a day on, and the children that still have one."""
    kept = parents.where(F.col(day) >= cutoff)
    return kept, children.join(kept.select(key), key, "left_semi")


# Fixed values of the repair rules.
UNIT, LARGE, MEDIAN_TIMES, ROW_TIMES, MARGIN_TIMES = 1e8, 1e7, 1e6, 1e4, 8


def repaired(df: DataFrame) -> DataFrame:
    """df: code, revenue, ebitda, net_debt, multiple.  Amounts in a wrong unit are rescaled, implausible ones cleared, polluted rows dropped."""
    old = F.col("net_debt").isNotNull()
    rescale = lambda c, when: F.when(when, F.col(c) / UNIT).otherwise(F.col(c))
    one = df.withColumns({"ebitda": rescale("ebitda", old & (F.abs("ebitda") > LARGE)), "net_debt": rescale("net_debt", old & (F.abs("net_debt") > LARGE))})
    usual = one.groupBy("code").agg(F.percentile(F.when(F.abs("ebitda") < LARGE, F.abs("ebitda")), F.lit(0.5)).alias("_e"), F.percentile(F.when(F.col("revenue") > 0, F.col("revenue")), F.lit(0.5)).alias("_r"))
    two = one.join(usual, "code").withColumn("ebitda", rescale("ebitda", F.coalesce(F.abs("ebitda") > MEDIAN_TIMES * F.col("_e"), F.lit(False))))
    wild = F.coalesce((F.col("revenue") > 0) & (F.col("ebitda") > F.col("revenue") * MARGIN_TIMES), F.lit(False))
    three = two.withColumns({c: F.when(~wild, F.col(c)) for c in ("ebitda", "multiple")})
    return three.where(F.coalesce((F.col("revenue") <= 0) | (F.col("revenue") <= ROW_TIMES * F.col("_r")), F.lit(True))).drop("_e", "_r")


def last_two(bars: DataFrame) -> DataFrame:
    """code, n, last, before: the last two stored dates."""
    k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("bar_date")))
    return bars.withColumn("_k", k).where("_k <= 2").groupBy("code").agg(F.count("*").alias("n"), F.max("bar_date").alias("last"), F.min("bar_date").alias("before"), F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("before_close"))


def fetch_plan(codes: DataFrame, stored: DataFrame, overlap: int = 3) -> DataFrame:
    """Per code: seed without stored bars, else from some days before the last but one."""
    at = last_two(stored).select("code", F.date_sub("before", overlap).alias("since"))
    return codes.join(at, "code", "left").withColumn("mode", F.when(F.col("since").isNull(), "seed").otherwise("incremental"))


def merged_series(stored: DataFrame, fresh: DataFrame, full: DataFrame, eps: float = 0.01) -> DataFrame:
    """Fresh bars are merged by (code, bar_date); a code whose last but one stored close has changed is dropped and loaded again from full."""
    seen = last_two(stored).where("n = 2").select("code", F.col("before").alias("bar_date"), "before_close")
    moved = seen.join(fresh, ["code", "bar_date"]).where(F.abs(F.col("close") - F.col("before_close")) > eps).select("code")
    calm = upsert(stored.join(moved, "code", "left_anti"), fresh.join(moved, "code", "left_anti").withColumn("ord", F.lit(0).cast("long")), ["code", "bar_date"], "ord")
    return calm.unionByName(full.join(moved, "code", "left_semi"))


def minute_quotes(ticks: DataFrame) -> DataFrame:
    """ticks: name, kind, ts, value, ord.  The last quote of a name in each minute."""
    return ticks.groupBy("name", F.date_trunc("minute", "ts").alias("minute")).agg(F.max_by("kind", F.struct("ts", "ord")).alias("kind"), F.max_by("value", F.struct("ts", "ord")).alias("value"))


def staleness(quotes: DataFrame, kinds: list[str], now: Column, seconds: int) -> DataFrame:
    """Per kind, also those without a quote: whether its newest minute is too old."""
    known = quotes.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    newest = quotes.groupBy("kind").agg(F.max("minute").alias("newest"))
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp")) >= seconds * 1_000_000
    return known.join(newest, "kind", "left").withColumn("stale", F.coalesce(old, F.lit(True)))


def new_items(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found: title, link, ord.  The first of equal titles in a run, without links that are stored."""
    return latest(found, ["title"], [F.col("ord")]).join(stored.select("link"), "link", "left_anti")


def latest_runs(log: DataFrame, since: Column) -> DataFrame:
    """log: job, ts, status.  Each job's last run, and its failures from a time on."""
    return log.groupBy("job").agg(F.max("ts").alias("last"), F.max_by("status", "ts").alias("status"), F.count_if((F.col("ts") >= since) & (F.col("status") != "ok")).alias("failures"))


def latest_events(events: DataFrame, most: int) -> DataFrame:
    """events: code, kind, day, text, ord.  The newest of each kind (the first on a day), then a code's newest kinds."""
    of_kind = latest(events, ["code", "kind"], [F.desc("day"), F.col("ord")])
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("day"), "kind"))
    return of_kind.withColumn("place", place).where(F.col("place") <= most).drop("ord")


def changed_since(cache: DataFrame, bars: DataFrame) -> DataFrame:
    """Codes whose last bar isn't the one that the cached row was made from."""
    now = bars.groupBy("code").agg(F.max("bar_date").alias("last"))
    return now.join(cache, (now["code"] == cache["code"]) & (now["last"] == cache["last"]), "left_anti")


# Ownership.  Fixed values: the bounds of the classes and filters.
def holding_class(percent: Column) -> Column:
    return F.when(percent >= 50, "dominant").when(percent >= 30, "stable").when(percent.isNotNull(), "dispersed")


def floating_class(percent: Column) -> Column:
    return F.when(percent >= 60, "wide").when(percent >= 30, "fair").when(percent.isNotNull(), "tight")


def significance(profit: Column, parent_profit: Column, purpose: Column, words: list[str]) -> Column:
    """Tags of a subsidiary: a tenth of the parent's profit, a loss, a new business."""
    hit = lambda when, tag: F.when(F.coalesce(when, F.lit(False)), tag)
    tags = [hit((parent_profit > 0) & (profit >= parent_profit * 0.1), "profit"), hit(profit < 0, "loss"), hit(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(purpose), w)), "new business")]
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def shown_subsidiary(tags: Column, stake: Column, book: Column) -> Column:
    return (F.size(tags) > 0) | F.coalesce(stake >= 5, F.lit(False)) | F.coalesce(book >= 1_000_000_000, F.lit(False))


def stakes(holders: DataFrame, shares: DataFrame) -> DataFrame:
    """holders: code, stake; shares: code, issued, treasury, new.  Sum of stakes, floating ratio and dilution, with classes."""
    total = holders.groupBy("code").agg(F.sum("stake").alias("sum"))
    out = F.col("issued") - F.coalesce("treasury", F.lit(0))
    part = shares.select("code", F.when(F.col("issued") > 0, F.round(out / F.col("issued") * 100, 2)).alias("floating"), F.when((F.col("new") > 0) & (out > 0), F.round(F.col("new") / out * 100, 2)).alias("dilution"))
    both = part.join(total, "code", "left").withColumn("group_stake", F.when(F.col("sum") > 0, F.round("sum", 2))).drop("sum")
    return both.withColumns({"group_class": holding_class(F.col("group_stake")), "floating_class": floating_class(F.col("floating"))})


def holder_snapshot(rows: DataFrame, changes: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """rows: code, name, stake, ord; changes: code, name, day, after.  Each name's best stake, and names that went to nothing within a year."""
    best = latest(rows, ["code", "name"], [F.desc(F.coalesce("stake", F.lit(0.0))), F.col("ord")]).where("stake > 0").drop("ord")
    gone = changes.where((F.coalesce("after", F.lit(0.0)) == 0) & (F.datediff(today, F.col("day")) <= 365)).groupBy("code", "name").agg(F.max("day").alias("day"))
    return best, gone.join(best, ["code", "name"], "left_anti")


def orphans(changes: DataFrame, *known: DataFrame) -> DataFrame:
    """The newest change of reporters that are in none of several lists."""
    rest = changes
    for k in known:
        rest = rest.join(k.select("code", "name").distinct(), ["code", "name"], "left_anti")
    return rest.groupBy("code", "name").agg(F.max("day").alias("day"), F.count("*").alias("n"))
