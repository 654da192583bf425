"""The most alike rows of a stated set of queries: vectors by cosine, names by the ratio of matching characters.

Both are exact.  Vectors meet in blocks, as products of matrices.  Names meet through an
index of pairs of neighbouring letters, from the highest likeness down; only queries that have
too few alike names go on to the next lower bound, and at last to a scan in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.operators.shared import stored

#: Vectors of a block of rows, and queries that are sent to tasks at once.
ROWS, QUERIES = 4_096, 4_096


def nearest_by_cosine(base: DataFrame, asked: DataFrame, k: int = 5, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """base: id, v.  asked: q, qv.  q, id, rank, score: the k rows of the largest cosine, but the query's own; ties to the smaller id.

    Queries go to tasks in blocks of at most ``queries`` vectors.  A task multiplies blocks of its rows
    with them and keeps k rows for each query, so the shuffle has k rows for each task and query, whatever the
    number of rows.  Vectors that are null or zero, or hold nulls or non-finite
    numbers, take no part; all others must have one width.
    """
    n = asked.count()
    parts = max(1, -(-n // queries))
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("q"), F.lit(parts)))
    found = reduce(DataFrame.unionByName, [_block_top(base, dealt.where(F.col("_block") == i), k, rows) for i in range(parts)])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")  # k rows for each task
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "id", "rank", "score")


def _matrix(ids: list, vectors: list) -> tuple[list, np.ndarray]:
    """Unit vectors of the usual width, and their ids."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in zip(ids, vectors) if v is not None and None not in v]
    ok = [(i, v) for i, v in ok if len(v) and np.isfinite(v).all() and v.any()]
    return [i for i, _ in ok], np.stack([v / np.sqrt((v * v).sum()) for _, v in ok]) if ok else np.zeros((0, 0))


def _block_top(base: DataFrame, asked: DataFrame, k: int, rows: int) -> DataFrame:
    held = asked.select("q", "qv").collect()  # a block: counted, at most about QUERIES rows
    q_ids, q = _matrix([r.q for r in held], [r.qv for r in held])
    sent = base.sparkSession.sparkContext.broadcast((q_ids, q))
    id_type, q_type = base.schema["id"].dataType, asked.schema["q"].dataType
    schema = T.StructType([T.StructField("q", q_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_q, m = sent.value
        best: list[list[tuple[float, object]]] = [[] for _ in own_q]  # (score, id), best first
        for batch in batches:
            for a in range(0, batch.num_rows if own_q else 0, rows):
                part = batch.slice(a, rows)
                ids, x = _matrix(part.column(0).to_pylist(), part.column(1).to_pylist())
                if not ids:
                    continue
                scores = x @ m.T
                order = np.array(ids)
                for j, own in enumerate(own_q):
                    s = scores[:, j]
                    if len(best[j]) == k:
                        near = np.flatnonzero(s >= best[j][-1][0])
                    elif len(s) > 4 * k:  # ties at the edge stay in
                        near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                    else:
                        near = np.arange(len(s))
                    if len(near):
                        more = [(float(s[i]), ids[i]) for i in near if ids[i] != own]
                        best[j] = sorted(best[j] + more, key=lambda x: (-x[0], x[1]))[:k]
        out = [(own, i, s) for own, found in zip(own_q, best) for s, i in found]
        if out:
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(q_type), to_arrow_type(id_type), pa.float64()))], names=["q", "id", "score"])

    return base.select("id", "v").mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two strings; no built-in function has it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: Likenesses that the index is asked for, one after the other; it says nothing below two thirds.
LEVELS = (0.9, 0.8, 0.75)


def _least_shared(length: Column, t: float) -> Column:
    """Pairs of neighbouring letters that a name of this length shares at least with any name of likeness t.

    Of T letters in all, M = t T / 2 match, in blocks.  Between two blocks there is a letter without a match in one
    of the names, of which there are T - 2 M, so there are at most T - 2 M + 1 blocks and M - (T - 2 M + 1) shared
    pairs inside them.  T is least for the shortest name that can be so alike, of t / (2 - t) times the length.
    """
    total = length + F.ceil(length * (t / (2 - t)) - 1e-9)
    return F.ceil(total * (1.5 * t - 1) - 1 - 1e-9)


def _grams(names: DataFrame) -> DataFrame:
    """names: low.  low, gram: pairs of neighbouring letters, each with the number of its occurrence in the name."""
    at = F.sequence(F.lit(1), F.length("low") - 1)
    pairs = F.transform(at, lambda i: F.substring(F.col("low"), i, F.lit(2)))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda h: h == g)).cast("string")))
    return names.where(F.length("low") > 1).select("low", F.explode(numbered).alias("gram"))


def _prefixes(grams: DataFrame, counts: DataFrame, t: float) -> DataFrame:
    """low, gram: the rarest pairs of a name, so many that two names of likeness t have one of them in common."""
    own = grams.join(counts, "gram", "left").groupBy("low").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))  # the letters of one name
    least = _least_shared(F.length("low"), t)
    kept = F.slice("g", 1, F.greatest(F.lit(0), F.size("g") - least + 1).cast("int"))
    return own.where((least > 0) & (F.size("g") >= least)).select("low", F.explode(kept).alias("x")).select("low", F.col("x.gram").alias("gram"))


def alike_names(names: DataFrame, asked: DataFrame, t: float) -> DataFrame:
    """names, asked: low (lower case, all different).  asked_low, low, score of all pairs whose likeness is at least t (above two thirds).

    Names too short for any shared pair to be certain, of which there are few, are compared with all of their lengths.
    """
    counts = stored(_grams(names).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    ratio = t / (2 - t)
    fits = lambda a, b: (F.length(b) >= F.length(a) * ratio - 1e-9) & (F.length(b) <= F.length(a) / ratio + 1e-9)
    mine = _prefixes(_grams(asked), counts, t).withColumnRenamed("low", "asked_low")
    pairs = mine.join(_prefixes(_grams(names), counts, t), "gram").where(fits("asked_low", "low")).select("asked_low", "low").distinct()
    short = lambda df: df.where(_least_shared(F.length("low"), t) <= 0)
    lengths = F.explode(F.sequence(F.ceil(F.length("low") * ratio - 1e-9).cast("int"), F.floor(F.length("low") / ratio + 1e-9).cast("int"))).alias("size")
    by_size = short(asked).where(F.length("low") > 0).select(F.col("low").alias("asked_low"), lengths).join(names.select("low", F.length("low").alias("size")), "size").select("asked_low", "low")
    by_own = asked.select(F.col("low").alias("asked_low"), F.length("low").alias("size")).join(short(names).where(F.length("low") > 0).select("low", lengths), "size").select("asked_low", "low")
    every = pairs.union(by_size).union(by_own).distinct()
    return every.withColumn("score", sequence_ratio("asked_low", "low")).where(F.col("score") >= t - 1e-12)


def fuzzy_top(names: DataFrame, queries: DataFrame, k: int = 5, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """names: id, name.  queries: q.  q, id, name, score, rank: the k most alike names of each query, case aside, those of score 0 left out.

    Ties go to the smaller id.  Equal names are compared once, and the k smallest ids of each are kept.
    """
    low = names.where("name is not null").select("id", "name", F.lower("name").alias("low")).distinct()
    held = stored(_first_ids(low, k), "names")
    asked = stored(queries.where("q is not null").select("q", F.lower("q").alias("low")).distinct(), "asked")
    left, done = asked.select("low").distinct(), []
    for t in levels:
        pairs = stored(alike_names(held.select("low"), left, t), "alike")
        # ids count, not names: a name with k ids is enough
        enough = pairs.join(held.select("low", F.size("ids").alias("n")), "low").groupBy("asked_low").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("asked_low")
        enough = stored(enough, "enough")
        done.append(pairs.join(enough, "asked_low", "left_semi"))
        left = stored(left.join(enough.withColumnRenamed("asked_low", "low"), "low", "left_anti"), "left")
        if left.isEmpty():
            break
    else:
        done.append(_scan(held, left, k))
    scored = reduce(DataFrame.unionByName, done).join(held, "low").select("asked_low", F.inline("ids"), "score")
    order = Window.partitionBy("asked_low").orderBy(F.desc("score"), "id")  # k ids at most for each alike name
    top = scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.withColumnRenamed("low", "asked_low"), "asked_low").select("q", "id", "name", "score", "rank")


def _first_ids(low: DataFrame, k: int) -> DataFrame:
    """low, ids: the k smallest ids of each name with their spellings."""
    order = Window.partitionBy("low", "_part").orderBy("id", "name")
    # a name that many ids have is cut to k in parts first
    parts = low.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return parts.groupBy("low").agg(F.slice(F.sort_array(F.collect_list(F.struct("id", "name"))), 1, k).alias("ids"))


def _scan(held: DataFrame, left: DataFrame, k: int, block: int = 100) -> DataFrame:
    """asked_low, low, score of the k best names of queries that have few alike ones.

    Blocks of queries go to all partitions of names; twice the letters that two names share, over
    their lengths, bounds the likeness, so a partition's names are scored from the highest bound down.
    """
    spark = held.sparkSession
    parts = max(1, -(-left.count() // block))
    dealt = left.withColumn("_block", F.pmod(F.xxhash64("low"), F.lit(parts)))
    found = []
    for i in range(parts):
        sent = spark.sparkContext.broadcast([r.low for r in dealt.where(F.col("_block") == i).select("low").collect()])  # a block: counted

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[str, list[tuple[float, str, int]]] = {q: [] for q in sent.value}
            for batch in batches:
                low, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sizes = np.array([len(x) for x in low], dtype=np.int64)
                letters = {c: np.array([x.count(c) for x in low], dtype=np.int64) for c in {c for q in best for c in q}}
                for q, top in best.items():
                    shared = np.zeros(len(low), dtype=np.int64)
                    for c in set(q):
                        shared += np.minimum(letters[c], q.count(c))
                    bound = 2.0 * shared / np.maximum(sizes + len(q), 1)
                    matcher = SequenceMatcher(None)
                    matcher.set_seq1(q)
                    for j in np.argsort(-bound, kind="stable"):
                        if bound[j] <= 0 or (sum(n for *_, n in top) >= k and bound[j] + 1e-9 < top[-1][0]):
                            break
                        matcher.set_seq2(low[j])
                        score = matcher.ratio()
                        top.append((score, low[j], ids[j]))
                        top.sort(key=lambda x: (-x[0], x[1]))
                        # what stands below k ids of better names isn't needed
                        kept, n = [], 0
                        for x in top:
                            if n >= k and x[0] < kept[-1][0]:
                                break
                            kept.append(x)
                            n += x[2]
                        top[:] = kept
            out = [(q, name, score) for q, top in best.items() for score, name, _ in top]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["asked_low", "low", "score"])

        found.append(held.select("low", F.size("ids")).mapInArrow(run, "asked_low string, low string, score double"))
    return reduce(DataFrame.unionByName, found)
