"""Nearest neighbours by a permutation index.

A vector is represented by the order of its ``PREFIX`` nearest pivots out of
``PIVOTS``.  Candidates lie in blocks; each block has an inverted file for every
pivot: which rows have it among their nearest, and in which place.  A query
goes through the files of its own pivots and adds up, for each row met, how
much the footrule distance between the two orders falls below that of orders
with nothing in common.  The ``RERANK`` share of a block with the least footrule
distance is ranked again by the exact inner product, in double precision.

Pivots come from a bounded sample (the ``SAMPLE`` different vectors with the
smallest hashes); every row is indexed.  Equal vectors are one entry with the smallest
``k + 1`` ids, more can't be among anyone's k nearest: exact copies never meet
in one task (the limit for each vector is taken before the shuffle).  Blocks
hold vectors of like norm, so that the order of directions is the order of inner
products.  Queries are a stated set; they are dealt into blocks too, and each
block of queries meets each block of rows, so a task holds ``BLOCK`` rows and
``QUERIES`` queries, whatever the table.

The share that is reranked decides recall: in vectors of many independent
dimensions an order of pivots tells little, and wider ones than those measured
(64) may need a larger ``rerank``; 1.0 makes the search exact.

Rows: components keep their precision (float or double); null or zero vectors and those with null or non-finite components, or
with another number of components than most rows have, take no part; rows with
one id and one vector count once; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

PIVOTS = 256
PREFIX = 64
#: Different vectors that pivots are chosen from, and the largest cosine between two pivots.
SAMPLE = 2_048
APART = 0.8
BLOCK = 4096
QUERIES = 4096
RERANK = 0.2
#: Rows of a block that are always reranked.
LEAST = 400
#: Width of the norm bands, as a logarithm.
BAND = 0.1


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Directions from the sample, in its order, that lie apart from each other: a cluster gives one pivot, not many."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[np.ndarray] = []
    for v in unit:
        if len(chosen) == most:
            break
        if not chosen or (np.array(chosen) @ v).max() < APART:
            chosen.append(v)
    return np.array(chosen)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    near = -(vectors @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """The rows and places of one block, by pivot."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        self.n = n
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of a query's order from each row's; a pivot that one order lacks counts as the place after the last."""
        nearer = np.zeros(self.n, dtype=np.int32)
        for place, pivot in enumerate(query):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            nearer[self.rows[a:b]] += 2 * (self.prefix - np.maximum(place, self.places[a:b]))
        return self.prefix * (self.prefix + 1) - nearer


def block_search(ids: list, vectors: np.ndarray, pivots: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: float = RERANK, prefix: int = PREFIX) -> list[list[tuple[float, int]]]:
    """For each query its nearest k of this block: (score, id), nearest first."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    prefix = min(prefix, len(pivots))
    files = InvertedFiles(orders(unit(vectors), pivots, prefix), len(pivots))
    most = min(len(vectors), max(LEAST, int(np.ceil(rerank * len(vectors)))))
    out = []
    for q, v, order in zip(query_ids.tolist(), queries, orders(unit(queries), pivots, prefix)):
        if most < len(vectors):
            near = np.argpartition(files.footrule(order), most - 1)[:most]
        else:
            near = np.arange(len(vectors))
        scores = (vectors[near] * v).sum(axis=1)
        if len(near) > k + 1:  # an entry has an id that isn't the query's, unless it's the query alone
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            near, scores = near[scores >= least], scores[scores >= least]
        found = [(s, i) for s, r in zip(scores.tolist(), near.tolist()) for i in ids[r] if i != q]
        out.append(sorted(found, key=lambda x: (-x[0], x[1]))[:k])
    return out


def search(base: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", rerank: float = RERANK) -> DataFrame:
    """query_id, rank, id, score: for each row of queries its nearest rows of base with other ids."""
    spark = base.sparkSession
    kind = "array<float>" if dict(base.dtypes)[vector_column] == dict(queries.dtypes)[vector_column] == "array<float>" else "array<double>"
    pick = lambda df: df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast(kind).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = pick(base)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    rows = rows.where(F.size("v") == sizes[0]["d"])
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.distinct().withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = common.stored(entries.withColumn("band", F.floor(F.log(_norm(F.col("v"))) / BAND)), "vectors")
    pivots = choose_pivots(np.array([r["v"] for r in entries.orderBy(F.xxhash64(F.lit(10), "v"), "v").limit(SAMPLE).select("v").collect()], dtype=np.float64))
    # blocks of each band of norms: a band's entries by hash
    plan = entries.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # log(largest / smallest norm) / BAND rows
    placed = entries.join(F.broadcast(plan), "band").select("band", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), "v", "ids")
    asked = common.stored(pick(queries).where(F.size("v") == sizes[0]["d"]).distinct().select("id", F.col("v").alias("qv")), "queries")
    parts = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    bands = plan.agg(F.collect_list(F.struct("band", "blocks")))  # log(largest / smallest norm) / BAND of them
    sent = asked.select("id", "qv", "part", F.explode(bands.scalar()).alias("b"))
    sent = sent.select("b.band", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("block"), "part", "id", "qv")

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "found": pd.Series(dtype="object")})
        vectors = np.stack(own["v"].to_numpy()).astype(np.float64)
        got = block_search(own["ids"].tolist(), vectors, pivots, asked["id"].to_numpy(), np.stack(asked["qv"].to_numpy()).astype(np.float64), k, rerank)
        return pd.DataFrame({"query_id": asked["id"].to_numpy(), "found": [[{"score": s, "id": i} for s, i in x] for x in got]})

    key = ["band", "block", "part"]
    found = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(run, "query_id bigint, found array<struct<score: double, id: bigint>>")
    each = found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.id", "f.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    base = common.table(spark, sf_dir, "embeddings")
    return search(base, base.where(F.col("vec_id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")
