"""Parsing of pages, frames and report cells with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import label_key, parse_number

#: Unit words and what a number beside them counts.
UNITS = {"원": 1.0, "천원": 1e3, "백만원": 1e6, "억원": 1e8, "thousands": 1e3, "millions": 1e6, "billions": 1e9}


def plain(html: Column) -> Column:
    """Text of a fragment: no tags, basic entities, single spaces."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_list(pages: DataFrame) -> DataFrame:
    """Title, language, links and paragraphs of each page."""
    return pages.select(
        "page_id", plain(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), F.regexp_extract("html", r'<html[^>]*\blang="([a-zA-Z-]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("links"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)(<p[ >])"), 1)).alias("paragraphs"),
    )


def frames(lines: DataFrame, least: int = 14) -> DataFrame:
    """Ticks of '0|TYPE|count|f0^f1^...' lines: the last record of each; other lines give no row."""
    parts = F.split("value", r"\|")
    fields = F.split(F.get(parts, F.lit(3)), r"\^")
    n = F.get(parts, F.lit(2)).try_cast("int")
    each = F.floor(F.size(fields) / n).cast("int")
    good = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "0") & (F.get(parts, F.lit(1)) == "H0STCNT0") & (n > 0)
    rows = lines.where(F.coalesce(good, F.lit(False))).select(fields.alias("f"), F.when(n > 0, each).alias("w")).where(F.col("w") >= least)
    at = lambda i: F.get("f", F.size("f") - F.col("w") + i)
    return rows.select(at(0).alias("code"), at(1).alias("time"), at(2).try_cast("double").alias("price"), at(5).try_cast("double").alias("change_pct"), at(13).try_cast("long").alias("volume"))


def cells(rows: DataFrame) -> DataFrame:
    """rows: doc, n, label, value, text.  Numbers of labelled cells, by the unit that was declared last before them."""
    from pyspark.sql import Window

    unit = F.lit(None).cast("double")
    for word, factor in sorted(UNITS.items(), key=lambda x: len(x[0])):
        unit = F.when(F.lower("text").rlike(rf"(단위|in|unit)\s*[:：]?\s*{word}"), factor).otherwise(unit)
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("factor", F.coalesce(F.last(unit, ignorenulls=True).over(w), F.lit(1.0))).where("label is not null")
    return out.select("doc", "n", label_key(F.col("label")).alias("label"), (parse_number(F.col("value")) * F.col("factor")).alias("amount"))


def plausible(amount: Column, revenue: Column, most: float = 8.0) -> Column:
    return F.when(amount.isNotNull() & ((revenue.isNull()) | (F.abs(amount) <= most * F.abs(revenue))), amount)


def statement_field(items: Column, ids: list[str], names: list[str]) -> Column:
    """The amount of the first item with one of the ids, else with one of the names (ids in order of preference)."""

    # a lambda with a second parameter would be given the item's place
    def first(wanted: Column, of: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(items, lambda x: of(x) == wanted), F.lit(0))["amount"]

    by_id = [first(F.lit(i), lambda x: x["account_id"]) for i in ids]
    by_name = [first(label_key(F.lit(n)), lambda x: label_key(x["name"])) for n in names]
    return F.coalesce(*by_id, *by_name)


def json_in_text(text: Column, schema: str) -> Column:
    """The first {...} of a text, read as JSON; missing where it can't be."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
