"""From banded signatures to classes: candidate pairs, verification, union-find.

Pairs are not emitted for all of a bucket.  Each member is first compared with
the smallest node of all its buckets, then with the smallest of each other bucket
unless both are linked to one node already; verified links join members into components.  What is left are the members outside the largest component of a
bucket: they meet the bucket's other members in a join whose condition holds an
exact bound.  Each text has a parity map of its elements (bit i tells whether an
odd number of them falls on i), and two maps differ in no more bits than the
sets differ in elements; so a pair whose maps differ in too many bits can't be a
link, and only near pairs leave the join and are verified.  While that join
would still make more than ``COMPARISONS`` comparisons for each member, further rounds
compare the members that are left with ``PIVOTS`` random members of the largest
component, which costs the number of members; they go on as long as each takes
away half of the comparisons.  No link between different
components is lost, and neither thousands of near copies nor thousands of texts
around one passage give a quadratic number of pairs.

Buckets are found by partial aggregation (count, smallest, largest).  Hot
buckets meet in joins, which adaptive execution splits, never in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .sketches import UNIT, units

#: Bucket keys that are broadcast at most (16 MB); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000

#: 64-bit words of a parity map.
WORDS = 16
#: Comparisons for each member row that the last join may make while further rounds still help.
COMPARISONS = 256
PIVOTS = 4

#: (text number, element) of texts, by ascending text number; an element that repeats in a text counts once.
Elements = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b.  (node, root) for every node of an edge; root is its component's smallest node.

    Alternating large stars and small stars: after each round a component's
    edges point to smaller nodes, and its depth falls by a constant factor.
    """
    state = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour goes to the smallest
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        state = common.cut(small)
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select("b").distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def distinct(doc: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element number) without repeats, ascending, and the elements by number."""
    kinds, number = np.unique(e, return_inverse=True)
    key = np.sort(doc * len(kinds) + number)
    doc, number = np.divmod(key[np.diff(key, prepend=-1) > 0], max(1, len(kinds)))
    return doc, number, kinds


def parity_maps(doc: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    """(n, WORDS) int64 for n sets of elements without repeats."""
    bits = 64 * WORDS
    odd = np.bincount(doc * bits + ((e >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").reshape(n, WORDS)


def maps(texts: DataFrame, elements: Elements) -> DataFrame:
    """texts: node, text.  node, n (its elements), m0, m1, ... (its parity map)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for a, b in units(own):
                doc, number, kinds = distinct(*elements(own[a:b]))
                m = parity_maps(doc, kinds[number], b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(doc, minlength=b - a)), *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(WORDS)]], names=["node", "n", *_MAP])

    return texts.select("node", "text").mapInArrow(run, "node bigint, n bigint, " + ", ".join(f"{c} bigint" for c in _MAP))


_MAP = [f"m{i}" for i in range(WORDS)]


def _near(similarity: float) -> Column:
    """What a link surely meets: sets of similarity t differ in (1 - t) / (1 + t) of their elements at most."""
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _MAP[1:]), F.bit_count(F.col("m0_a").bitwiseXOR(F.col("m0_b"))))
    return apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-6


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*[F.col(c).alias(c if c == "band" else f"{c}_{end}") for c in rows.columns]) for end in "ab")


def apart_pairs(apart: DataFrame, mapped: DataFrame, similarity: float) -> DataFrame:
    """apart: band, node, root, largest (the root of most of the band's members).  Pairs (a, b) of nodes of one band and other roots that may be links.

    A pair meets in each band that both are in and leaves the join in the smallest of these.
    """
    nodes = apart.groupBy("node", "root").agg(F.collect_list("band").alias("bands"), F.collect_list(F.struct("band", (F.col("root") == F.col("largest")).alias("main"))).alias("at"))  # as many as there are bands
    rows = nodes.join(mapped, "node").select("node", "root", "bands", "n", *_MAP, F.inline("at"))
    left, right = _sides(rows)
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")
    meet = (F.col("root_a") != F.col("root_b")) & (F.col("main_b") | (F.col("node_a") < F.col("node_b"))) & _near(similarity) & once
    both = left.where("not main_a").join(right, "band").where(meet)
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def pivot_pairs(apart: DataFrame, mapped: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Pairs of each node outside its bands' largest components and random members of these that may be links."""
    chosen = apart.where("root = largest").groupBy("largest").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64(F.lit(seed), F.lit(i), "node")) for i in range(PIVOTS)])).alias("to"))
    pairs = apart.where("root <> largest").select("node", "largest").distinct().join(chosen, "largest").select(F.col("node").alias("node_a"), F.explode("to").alias("node_b"))
    left, right = _sides(mapped)
    near = pairs.join(left, "node_a").join(right, "node_b").where(_near(similarity))
    return near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def alike(texts: list[str], a: np.ndarray, b: np.ndarray, elements: Elements, similarity: float) -> np.ndarray:
    """Whether the sets of texts[a[i]] and texts[b[i]] have that Jaccard similarity."""
    parts = [(elements(texts[i:j]), i) for i, j in units(texts)]
    doc, number, kinds = distinct(np.concatenate([d + i for (d, _), i in parts]), np.concatenate([e for (_, e), _ in parts]))
    size = np.bincount(doc, minlength=len(texts))
    stop = np.cumsum(size)
    marked = np.zeros(len(kinds), dtype=bool)
    ok, last = np.zeros(len(a), dtype=bool), -1
    for i in np.argsort(b, kind="stable").tolist():
        x, y = a[i], b[i]
        if y != last:
            if last >= 0:
                marked[number[stop[last] - size[last] : stop[last]]] = False
            marked[number[stop[y] - size[y] : stop[y]]] = True
            last = y
        shared = np.count_nonzero(marked[number[stop[x] - size[x] : stop[x]]])
        ok[i] = shared >= similarity * (size[x] + size[y] - shared)
    return ok


def verified(pairs: DataFrame, texts: DataFrame, elements: Elements, similarity: float) -> DataFrame:
    """pairs: a, b; texts: node, text.  The pairs that are links."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(2)).to_numpy().astype(np.int64) + pc.binary_length(whole.column(3)).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // UNIT)) + 1).tolist(), whole.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                batch, n = whole.slice(start, stop - start), stop - start
                if n:
                    _, first, inverse = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_index=True, return_inverse=True)
                    held = [batch.column(2)[i].as_py() if i < n else batch.column(3)[i - n].as_py() for i in first.tolist()]
                    yield batch.select(["a", "b"]).filter(pa.array(alike(held, inverse[:n], inverse[n:], elements, similarity)))
        common.release()

    return both.mapInArrow(run, "a bigint, b bigint")


def classes(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], elements: Elements, similarity: float) -> DataFrame:
    """items: node, bands (stored, unique nodes).  (node, root) of nodes that are linked.

    texts_of(nodes) adds the texts of nodes.
    """
    common.bound_batches(items.sparkSession)
    scratch = common.Scratch(items.sparkSession)
    try:
        return _classes(items, texts_of, elements, similarity, scratch)
    finally:
        scratch.drop()


def _classes(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], elements: Elements, similarity: float, scratch: common.Scratch) -> DataFrame:
    rows = items.select("node", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    buckets = scratch.stored(buckets, "buckets")
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    more = buckets.where("n > 2").select("band", "low")
    if 0 < more.count() <= BROADCAST_KEYS:
        more = F.broadcast(more)
    members = scratch.stored(rows.join(more, "band"), "members")
    stars = scratch.stored(members.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a < b").distinct(), "stars")
    # a node meets the smallest node of all its buckets first, and those of its other buckets unless both are linked to the same one
    tried = scratch.stored(pairs.union(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "pairs")
    texts = scratch.stored(texts_of(pairs.union(stars).select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
    linked = scratch.stored(verified(tried, texts, elements, similarity), "links")
    least = linked.groupBy("b").agg(F.min("a").alias("least"))
    to = [least.select(F.col("b").alias(c), F.col("least").alias(f"to_{c}")) for c in "ab"]
    still = stars.join(to[0], "a", "left").join(to[1], "b", "left").where(F.coalesce("to_a", "a") != F.coalesce("to_b", "b"))
    rest = scratch.stored(still.select("a", "b").join(tried, ["a", "b"], "left_anti"), "stars-apart")
    found = components(linked.union(scratch.stored(verified(rest, texts, elements, similarity), "links-stars")))
    tried = tried.union(rest)
    members, mapped, seed, before = members.select("band", "node"), None, 0, math.inf
    while True:
        # members of one bucket that are still apart
        placed = members.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
        sizes = scratch.stored(sizes.where("roots > 1").drop("roots"), "mixed")
        work = sizes.agg(F.sum("n").alias("rows"), F.sum((F.col("n") - F.col("most")) * F.col("n")).alias("comparisons")).head()
        if not work["rows"]:
            return found
        apart = scratch.stored(placed.join(sizes.select("band", "largest"), "band"), "apart")
        if mapped is None:
            mapped = scratch.stored(maps(texts.join(apart.select("node").distinct(), "node", "left_semi"), elements), "maps")
        last = work["comparisons"] <= COMPARISONS * work["rows"] or work["comparisons"] > before / 2
        before, seed = work["comparisons"], seed + 1
        again = apart_pairs(apart, mapped, similarity) if last else pivot_pairs(apart, mapped, similarity, seed)
        again = scratch.stored(again.join(tried, ["a", "b"], "left_anti"), "pairs-apart")
        late = scratch.stored(verified(again, texts, elements, similarity), "links-apart")
        if not late.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))
        if last:
            return found
        tried = tried.union(again)
