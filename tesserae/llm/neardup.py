"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Texts with the same words in the same order are one node at once (grouped by
128 bits of digest, with partial aggregation).  Nodes get a BagMinHash signature
of ``BANDS * ROWS`` registers; bands of it give candidate pairs, each verified by
the overlap of the two multisets (sum of minima over sum of maxima, at least
``SIMILARITY``), and links are joined by union-find on Spark.  At a similarity of
0.8 a pair shares a band with probability 0.995.

Rows: a null text counts as empty; texts without a word are alike only if they
are equal; a text of fewer than five words is one shingle; rows with one doc_id
are one document and share a class; rows with a null doc_id have no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, links
from .sketches import bag_minhash, bands, mix, signed, units, word_shingles

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 8, 28

_SKETCH = pa.schema([("doc_id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketch(docs: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """doc_id, two digests of the words, size of the multiset, band keys (null without words)."""

    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = common.worker_cache("near", dict)
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                ids, texts = part.column(0), part.column(1).to_pylist()
                for a, b in units(texts):
                    own = texts[a:b]
                    doc, key, count, one, two = word_shingles(own, shingle, tables)
                    size = np.bincount(doc, weights=count, minlength=b - a).astype(np.int64)
                    for i in np.flatnonzero(size == 0):  # no words: by their characters
                        raw = np.frombuffer(own[i].encode("utf-32-le"), dtype="<u4").astype(np.uint64)
                        at = np.arange(1, len(raw) + 1, dtype=np.uint64)
                        one[i], two[i] = (mix(np.array([mix(raw + mix(at * np.uint64(k))).sum() + np.uint64(k)], dtype=np.uint64))[0] for k in (0x9E3779B1, 0x85EBCA77))
                    keys = bands(bag_minhash(doc, key, count, b - a, rows * n_bands), rows)
                    offsets = np.arange(b - a + 1, dtype=np.int32) * n_bands
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys).ravel()), mask=pa.array(size == 0))
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(signed(one)), pa.array(signed(two)), pa.array(size), lists], schema=_SKETCH)

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), common.text_of().alias("text"))
    return source.mapInArrow(run, "doc_id bigint, one bigint, two bigint, size bigint, bands array<bigint>")


def elements(shingle: int) -> links.Elements:
    """A text's multiset as a set: its shingles, each with the number of its occurrence."""
    tables: dict = {}

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        doc, key, count, _, _ = word_shingles(texts, shingle, tables)
        number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(doc, count), mix(np.repeat(key, count) + mix(number.astype(np.uint64)))

    return of


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    found = docs.select(F.col("doc_id").alias("node"), common.text_of().alias("text")).join(common.sized(nodes), "node")
    # one text for each document, should rows repeat
    return found.groupBy(*nodes.columns).agg(F.min("text").alias("text")) if _repeats(docs) else found


def _repeats(docs: DataFrame) -> bool:
    n = docs.where("doc_id is not null").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).head()
    return n["n"] != n["d"]


def classify(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each document; class_id is the smallest doc_id of the class."""
    scratch = common.Scratch(docs.sparkSession)
    sketches = scratch.stored(sketch(docs, shingle), "sketches")
    groups = sketches.groupBy("one", "two").agg(F.min("doc_id").alias("node"))
    mapped = sketches.select("doc_id", "one", "two").join(groups, ["one", "two"]).select("doc_id", "node")
    # rows with one doc_id and several texts are one document
    known = common.stored(mapped.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")), "nodes")
    items = sketches.where("bands is not null").join(groups.select("one", "two", F.col("node").alias("doc_id")), ["one", "two", "doc_id"], "left_semi")
    items = items.select(F.col("doc_id").alias("node"), "bands").dropDuplicates(["node"])
    items = scratch.stored(items, "items")
    found = links.classes(items, lambda nodes: texts_of(docs, nodes), elements(shingle), similarity)
    scratch.drop()
    several = known.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    selves = known.where("doc_id <> node").join(known.select(F.col("doc_id").alias("node"), F.col("node").alias("real")), "node").where("node <> real").select(F.col("node").alias("a"), F.col("real").alias("b"))
    extra = several.union(selves)
    if not extra.isEmpty():
        found = links.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(extra))
    return known.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but the first row of each class, by doc_id and text; rows with a null doc_id stay.

    Rows with one doc_id are compared like others, so their texts go only if they are alike.
    """
    docs, back = common.apart(docs, ("doc_id", "text"))
    rows = common.placed(docs.where("doc_id is not null"))
    found = common.stored(classify(rows.select(F.col("_place").alias("doc_id"), "text")), "classes")
    gone = common.sized(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_place")))
    return back(rows.join(gone, "_place", "left_anti").drop("_place").unionByName(docs.where("doc_id is null")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents."""
    return classify(common.table(spark, sf_dir, "documents"))
