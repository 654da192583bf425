"""Ranks over any number of rows, without a window that holds them all in one task.

Rows (``numbered``) or different values with their counts (``standing``) are
dealt into ranges of the order and written to the shared folder.  What comes
before a range is a sum over one row for each range; inside a range a window
counts on.  A value that a third of all rows have is one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators.shared import stored

_IN_PART = (1 << 33) - 1
#: Different values that are broadcast at most to the rows that have them.
BROADCAST_VALUES = 1_000_000


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the number (from 1) of each row in the order; equal rows are dealt out, so the order need not be unique.

    Rows are written once; a column of the input called like the new one gives way.
    """
    df = df.drop(name)
    at, tie, part, before = fresh(df, "at", "tie", "part", "before")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    rows = stored(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part_of = F.shiftright(at, 33)
    sizes = rows.groupBy(part_of.alias(part)).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    joined = rows.join(F.broadcast(starts), part_of == F.col(part))
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit(_IN_PART)) + 1).drop(at, part, before)


def standings(df: DataFrame, values: list[str], within: list[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """df with where each of these numbers stands, and how to read it: a struct of below, same and ranked for each of them.

    below, same, ranked: rows of the same group with a smaller value, with this one, and with any.  All are
    missing where the value is; NaN is the largest number.  A missing group is a group.  All numbers are counted in one go.
    """
    groups = within or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"g{i}" for i in range(len(groups))]
    one = F.array(*[F.struct(F.lit(i).alias("which"), F.col(v).cast("double").alias("value")) for i, v in enumerate(values)])
    long = df.select(*[F.col(g).alias(o) for g, o in zip(groups, own)], F.inline(one)).where("value is not null")
    counts = long.groupBy(*own, "which", "value").agg(F.count("*").alias("same"))
    dealt = stored(counts.repartitionByRange(n, *own, "which", "value").withColumn("part", F.spark_partition_id()), "values")
    sizes = dealt.groupBy(*own, "which", "part").agg(F.sum("same").alias("size"))
    whole = Window.partitionBy(*own, "which")  # a row for each range
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(o).alias(f"s{o}") for o in own], F.col("which").alias("s_which"), F.col("part").alias("s_part"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("ranked"))
    same = (F.col("part") == F.col("s_part")) & (F.col("which") == F.col("s_which"))
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"s{o}"))
    inside = Window.partitionBy(*own, "which", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    known = dealt.withColumn("inside", F.coalesce(F.sum("same").over(inside), F.lit(0))).join(starts, same)
    small = dealt.count() <= BROADCAST_VALUES
    read, used = {}, []
    for i, v in enumerate(values):
        names = fresh(df, *[f"_{i}_{o}" for o in own], f"_{i}_value", f"_{i}_standing")
        right = known.where(F.col("which") == i).select(
            *[F.col(o).alias(c) for o, c in zip(own, names)], F.col("value").alias(names[-2]), F.struct((F.col("start") + F.col("inside")).alias("below"), "same", "ranked").alias(names[-1])
        )
        on = F.col(v).cast("double") == F.col(names[-2])
        for g, c in zip(groups, names):
            on = on & F.col(g).eqNullSafe(F.col(c))
        df = df.join(F.broadcast(right) if small else right, on, "left").drop(*names[:-1])
        read[v] = F.col(names[-1])
        used.append(names[-1])
    return df, read


def percentile_ranks(df: DataFrame, wanted: dict[str, tuple[str, bool]], within: list[str] | None = None) -> DataFrame:
    """wanted: new column: (value, descending).  Share of the others below (above, if descending) among rows of the group with a value.

    One half for a single row, 0 where the value is missing.
    """
    values = list(dict.fromkeys(v for v, _ in wanted.values()))
    out, standing = standings(df, values, within)
    for name, (v, descending) in wanted.items():
        s = standing[v]
        lower = s["ranked"] - s["below"] - s["same"] if descending else s["below"]
        out = out.withColumn(name, F.when(s.isNull(), 0.0).when(s["ranked"] <= 1, 0.5).otherwise(lower / (s["ranked"] - 1)))
    return out.select(*[c for c in df.columns if c not in wanted], *wanted)


def rating(df: DataFrame, value: str, name: str = "rating", within: list[str] | None = None) -> DataFrame:
    """1 to 99: the group's percentile, missing for fewer than two values."""
    out, standing = standings(df, [value], within)
    s = standing[value]
    share = F.bround(s["below"] / (s["ranked"] - 1) * 98) + 1
    return out.withColumn(name, F.when(s["ranked"] > 1, share.cast("int"))).select(*[c for c in df.columns if c != name], name)
