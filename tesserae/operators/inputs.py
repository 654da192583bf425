"""What ratio formulas read, from a company's statements: flows as trailing years, stocks as they open and close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def namespace(facts: DataFrame) -> DataFrame:
    """facts: code, n (number of the quarter), account, kind (stock or flow), amount.  code, n, values (a map) of each quarter.

    A flow is the sum of four quarters without a gap; a stock has ``:closing`` and, if the quarter a year before has it, ``:opening``,
    and stands for its closing by its bare name.  What can't be told isn't in the map; a
    quarter without anything has an empty one.  Of facts that repeat the largest counts.
    """
    one = facts.groupBy("code", "account", "kind", "n").agg(F.max("amount").alias("amount"))
    w = Window.partitionBy("code", "account", "kind").orderBy("n")
    year = F.when(F.lag("n", 3).over(w) == F.col("n") - 3, F.sum("amount").over(w.rowsBetween(-3, 0)))
    four = F.count("amount").over(w.rowsBetween(-3, 0)) == 4
    before = F.last("amount").over(w.rangeBetween(-4, -4))
    each = one.select("code", "n", "account", "kind", "amount", F.when(four, year).alias("year"), before.alias("before"))
    name = F.col("account")
    entry = lambda key, value: F.struct(key.alias("key"), value.cast("double").alias("value"))
    stock = F.array(entry(name, F.col("amount")), entry(F.concat(name, F.lit(":closing")), F.col("amount")), entry(F.concat(name, F.lit(":opening")), F.col("before")))
    entries = F.when(F.col("kind") == "stock", stock).otherwise(F.array(entry(name, F.col("year"))))
    held = each.groupBy("code", "n").agg(F.flatten(F.collect_list(F.filter(entries, lambda e: e["value"].isNotNull()))).alias("e"))  # the accounts of one statement
    return held.select("code", "n", F.map_from_entries("e").alias("values"))
