"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, made to
sum to one.  The exponent (1 keeps the shares, 0 levels them) is found by
repeated section of [0, 1], each step one aggregate over the table of source
totals: either the largest exponent whose weights have the target entropy, or
the smallest that repeats no source more than ``repeat`` times.  Without a budget
the mixture has as many tokens as the least that leaves no source short of one
whole pass, so no document is lost; with a budget in tokens, sources may also
fall below one pass.

A source's tokens are drawn pass by pass.  Each pass goes through the source's
blocks of documents in a permutation of its own, and through a block in an order
of its own, both by seeded hashes; the last pass stops where the budget ends, at
one place (block, hash) that is found from the totals of the blocks in that
pass's order and then from the one block where it lies.  ``turn`` is the block's
number in its pass; ``at`` (0 to 1) is how far the source has come, so ordering by
it interleaves the sources at their weights.  No task ever holds a source's
documents, and texts are never shuffled unless there are more than
``BROADCAST_BLOCKS`` blocks.

Rows: a null source is a source of its own; a null or empty text has no tokens,
and goes with its source's whole passes (a source without tokens passes once);
repeated rows are drawn each, side by side (they share a block); long texts count
whole; columns of the input named pass_no, block, turn or at give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

REPEAT = 2.0
#: Documents of a block, about.
BLOCK_DOCS = 1_000
#: Sources that are broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Block turns that are broadcast at most.
BROADCAST_BLOCKS = 500_000
_SECTIONS = 16
_ROUNDS = 7


def tokens(text: Column) -> Column:
    """Words between white space: what a mixture counts, within a factor that all sources share."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, repeat: float | None = REPEAT, entropy: float | None = None, budget: float | None = None) -> float:
    """totals: tokens of each source."""
    known = totals.where("tokens > 0").agg(F.sum("tokens").alias("all"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("n")).head()
    if not known["n"]:
        return 1.0
    p = F.col("tokens") / float(known["all"])
    low, high = known["low"] / known["all"], known["high"] / known["all"]
    a, b = 0.0, 1.0

    def good(at: float, z: float, s: float) -> bool:
        """Whether this exponent is flat enough (entropy), or steep enough (repetition)."""
        if entropy is not None:
            return math.log(z) - at * s / z >= entropy
        most = low ** (at - 1) / z * budget / known["all"] if budget else (low / high) ** (at - 1)
        return most <= repeat * (1 + 1e-12)

    for _ in range(_ROUNDS):
        grid = [a + (b - a) * i / _SECTIONS for i in range(_SECTIONS + 1)]
        sums = [f(x) for x in grid for f in (lambda x: F.sum(F.pow(p, F.lit(x))), lambda x: F.sum(F.pow(p, F.lit(x)) * F.log(p)))]
        got = totals.where("tokens > 0").agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).head()
        ok = [good(x, got[2 * i], got[2 * i + 1]) for i, x in enumerate(grid)]
        if entropy is not None:  # the last that is flat enough
            i = max((i for i, y in enumerate(ok) if y), default=0)
            if i == _SECTIONS:
                return grid[i]
            a, b = grid[i], grid[i + 1]
        else:  # the first that is steep enough
            i = next((i for i, y in enumerate(ok) if y), _SECTIONS)
            if i == 0:
                return grid[0]
            a, b = grid[i - 1], grid[i]
    return a if entropy is not None else b


def plan(docs: DataFrame, repeat: float | None = REPEAT, entropy: float | None = None, budget: float | None = None, seed: int = 7) -> DataFrame:
    """A row for each source: tokens, weight, passes, blocks, and where the last pass stops.

    docs: source, n (its tokens), key (a hash of its row).
    """
    totals = common.cut(docs.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    at = exponent(totals, repeat, entropy, budget)
    known = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("high")).head()
    every, high = float(known["all"] or 0) or 1.0, float(known["high"] or 0) or 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / every, F.lit(at))).otherwise(0.0)
    z = totals.agg(F.sum(power).alias("z")).head()["z"] or 1.0
    size = float(budget) if budget else (high / every) ** (1 - at) * z * every
    passes = F.when(F.col("tokens") > 0, F.col("weight") * size / F.col("tokens")).otherwise(1.0)
    sources = totals.withColumn("weight", power / z).withColumn("passes", F.round(passes, 9)).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS))
    sources = common.cut(sources.withColumn("rest", (F.col("passes") - F.floor("passes")) * F.col("tokens")).withColumn("exponent", F.lit(at)))
    # the block of the last pass in which the budget ends, then the hash
    small = common.cut(_with_source(docs, sources.select("source", "blocks", "passes", "rest")).where("rest > 0").select("source", "passes", "rest", "n", F.pmod("key", "blocks").alias("block")).groupBy("source", "passes", "rest", "block").agg(F.sum("n").alias("n")))
    small = small.withColumn("order", _order(seed, F.floor("passes").cast("int") + 1))
    upto = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = small.withColumn("sum", F.sum("n").over(upto)).where("sum >= rest").groupBy("source").agg(F.min(F.struct("order", "block", (F.col("rest") - F.col("sum") + F.col("n")).alias("left"))).alias("e")).select(F.col("source").alias("s"), F.col("e.order").alias("stop_order"), F.col("e.block").alias("stop_block"), F.col("e.left").alias("left"))
    ends = common.cut(ends)
    inside = _with_source(docs, sources.select("source", "blocks").join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")).where(F.pmod("key", "blocks") == F.col("stop_block"))
    inside = inside.groupBy("source", "left", "key").agg(F.sum("n").alias("n"))  # copies of a row are one row
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stops = inside.withColumn("sum", so_far).where("sum <= left").groupBy("source").agg(F.max("key").alias("stop_key")).withColumnRenamed("source", "s2")
    out = sources.join(ends.drop("left"), F.col("source").eqNullSafe(F.col("s")), "left").join(stops, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s", "s2")
    return common.cut(out)


def _order(seed: int, pass_no: Column) -> Column:
    """Where a block of a source (columns source, block) comes in a pass."""
    return F.xxhash64(F.lit(seed), F.col("source"), pass_no, F.col("block"))


def turns(sources: DataFrame, seed: int) -> DataFrame:
    """sources: source, passes, blocks.  source, pass_no, block, turn (from 1): the permutation of each pass."""
    each = sources.select("source", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("passes").cast("int")))).alias("pass_no"), "blocks")
    each = each.select("source", "pass_no", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    turn = F.row_number().over(Window.partitionBy("source", "pass_no").orderBy(_order(seed, F.col("pass_no")), "block"))  # a row for each BLOCK_DOCS documents
    return each.withColumn("block", F.col("block").cast("long")).withColumn("turn", turn)


def _with_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with the columns of their source's row."""
    right = sources.withColumnRenamed("source", "_source")
    if sources.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return docs.join(right, docs["source"].eqNullSafe(F.col("_source"))).drop("_source")


def draw(docs: DataFrame, repeat: float | None = REPEAT, entropy: float | None = None, budget: float | None = None, seed: int = 7) -> DataFrame:
    """docs, each row as often as it is drawn, with pass_no (from 1), block, turn (the block's number in the pass) and at (how far the source has come)."""
    docs, back = common.apart(docs, ("doc_id", "source", "text"), ("pass_no", "block", "turn", "at"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    measured = docs.select("source", tokens(F.col("text")).alias("n"), key.alias("key"))
    sources = plan(measured, repeat, entropy, budget, seed).select("source", "passes", "blocks", "stop_order", "stop_block", "stop_key")
    names = {c: f"_{c}" for c in ("passes", "blocks", "stop_order", "stop_block", "stop_key")}
    rows = _with_source(docs.withColumn("_key", key), sources.withColumnsRenamed(names)).withColumn("block", F.pmod("_key", "_blocks"))
    order = _order(seed, F.floor("_passes").cast("int") + 1)
    in_last = F.coalesce(F.struct(order, "block") < F.struct("_stop_order", "_stop_block"), F.lit(False)) & F.col("_stop_block").isNotNull()
    in_last = in_last | F.coalesce((F.col("block") == F.col("_stop_block")) & (F.col("_key") <= F.col("_stop_key")), F.lit(False))
    drawn = F.floor("_passes").cast("int") + in_last.cast("int")
    rows = rows.withColumn("_drawn", drawn).where("_drawn > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("_drawn"))))
    known = turns(sources, seed).withColumnsRenamed({"source": "_s", "pass_no": "_p", "block": "_b"})
    known = common.sized(common.stored(known, "turns"), BROADCAST_BLOCKS)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass_no") == F.col("_p")) & (F.col("block") == F.col("_b"))).drop("_s", "_p", "_b")
    inside = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pass_no", "_key"), 11) / float(1 << 53)
    at = F.least(F.lit(1.0), (F.col("pass_no") - 1 + (F.col("turn") - 1 + inside) / F.col("_blocks")) / F.greatest("_passes", F.lit(1e-9)))
    return back(rows.withColumn("at", at).drop("_key", "_drawn", *names.values()))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of the mixture of all documents that repeats no source more than twice."""
    drawn = draw(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return drawn.select("doc_id", "source", "pass_no", "block", "turn", "at", tokens(F.col("text")).alias("tokens"))
