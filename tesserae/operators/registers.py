"""Registers that are kept by key: rates, filings, segment sales, names under review, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators.relational import upsert


def latest_rates(rates: DataFrame, asked: DataFrame, otherwise: dict[str, float]) -> DataFrame:
    """rates: key, day, percent; asked: key.  key, rate (a fraction), day: the newest of each key, else the constant that is stated for it."""
    newest = rates.where("percent is not null").groupBy("key").agg(F.max_by(F.struct("percent", "day"), "day").alias("r"))
    constant = F.create_map(*[F.lit(x) for kv in otherwise.items() for x in kv]) if otherwise else F.create_map().cast("map<string,double>")
    return asked.join(newest, "key", "left").select("key", F.coalesce(F.col("r.percent") / 100, F.try_element_at(constant, F.col("key"))).alias("rate"), F.col("r.day").alias("day"))


def insert_new(stored: DataFrame, found: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of found whose key isn't stored, each key once (the first by order): what an insert that does nothing on conflict adds."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.join(stored.select(key), key, "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def newest_of(filings: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The newest filings of each company, numbered; a company with very many is cut down in parts first."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    cut = filings.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_n") <= most).drop("_part", "_n")
    return cut.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("number") <= most)


def segment_sales(stored: DataFrame, fresh: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """stored, fresh: key (company, year, segment), revenue.  The register after fresh rows replaced stored ones, with each segment's share of its company's year in percent."""
    kept = upsert(stored, fresh, key, ordinal)
    whole = kept.groupBy(*key[:-1]).agg(F.sum("revenue").alias("whole"))
    return kept.join(whole, key[:-1]).withColumn("ratio_pct", F.when(F.col("whole") != 0, F.round(F.col("revenue") / F.col("whole") * 100, 2))).drop("whole")


def review_states(resolved: DataFrame, rejected: DataFrame, promoted: DataFrame) -> DataFrame:
    """resolved: m_id, found, how; rejected: m_id; promoted: m_id, found.  State of each mention: canonical, rejected or pending.

    A reviewer's promotion gives a new mention its place; a rejection stands unless the mention was promoted later; what
    was found on its own isn't reviewed.
    """
    did = promoted.select("m_id", F.col("found").alias("given"), F.lit(None).cast("boolean").alias("no")).unionByName(rejected.select("m_id", F.lit(None).alias("given"), F.lit(True).alias("no")))
    out = resolved.join(did.groupBy("m_id").agg(F.max("given").alias("given"), F.max("no").alias("no")), "m_id", "left")
    new = F.col("how") == "new"
    found = F.when(new, F.col("given")).otherwise(F.col("found"))
    state = F.when(found.isNotNull(), "canonical").when(F.col("no"), "rejected").otherwise("pending")
    return out.select("m_id", found.alias("found"), F.when(new & F.col("given").isNotNull(), "review").otherwise(F.col("how")).alias("how"), state.alias("state"))


def filter_catalog(df: DataFrame, known: dict[str, tuple[str, str]]) -> DataFrame:
    """known: column: (label, operators).  A row for each filter and operator, with what the table has to filter: least, most, missing and different values."""
    one = df.agg(*[f.alias(f"{k}_{c}") for c in known for k, f in (("least", F.min(F.col(c).cast("double"))), ("most", F.max(F.col(c).cast("double"))), ("missing", F.count_if(F.col(c).isNull())), ("kinds", F.count_distinct(F.col(c))))])
    rows = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(label).alias("label"), *[F.col(f"{k}_{c}").alias(k) for k in ("least", "most", "missing", "kinds")], F.split(F.lit(ops), ",").alias("ops")) for c, (label, ops) in known.items()])
    return one.select(F.inline(rows)).select("id", "label", "least", "most", "missing", "kinds", F.explode("ops").alias("op"))


def without_key(json: Column, key: str) -> Column:
    """Whether a JSON object has no such key; what is no object has none."""
    return F.coalesce(~F.array_contains(F.json_object_keys(json), key), F.lit(True))
