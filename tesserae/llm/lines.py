"""Fuzzy line dedup: one line of each group of alike lines stays in the corpus.

Lines are compared in a normal form (lower case, runs of white space as one
space).  Equal forms are one node at once (128 bits of digest, partial
aggregation), however short they are.  Nodes have a MinHash signature over shingles of eight characters
and ``BANDS`` bands of ``ROWS`` registers; candidate pairs are verified by the
exact Jaccard similarity of their shingle sets (``SIMILARITY``), links are joined
by union-find on Spark, and of each component the first line by (doc_id, line
number) stays.  At a similarity of 0.8 a pair shares a band with probability
0.995.

Only blank lines are left alone.  A form shorter than a shingle is one shingle, the
form itself, so nothing but an equal form is alike: it has a digest and no bands.

Rows: a null text stays null and has no lines.  Each row has a place of its own: its
doc_id where that is unique, else its number in the order of (doc_id, text), written
to the shared folder.  So rows with one doc_id are compared like other rows, by their
order of text; lines of a null doc_id come last, so they give way to others.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, links
from .sketches import bands, char_shingles, one_permutation, signed, units

SHINGLE = 8
SIMILARITY = 0.8
ROWS, BANDS = 4, 10
#: Characters of the shortest form that is compared: all but blank lines.
MIN_CHARS = 1
#: Rows of a document's line numbers that are broadcast at most.
ROWS_BROADCAST = 200_000

_LINES = pa.schema([("place", pa.int64()), ("line", pa.int32()), ("again", pa.bool_()), ("one", pa.int64()), ("two", pa.int64()), ("bands", pa.list_(pa.int64()))])


def form(line: str) -> str:
    """A lower-case line with runs of white space as one space; a blank is the only white space that is printable."""
    return line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())


def forms(text: str, least: int) -> tuple[list[int], list[str]]:
    """Numbers (from 0) and normal forms of the lines that are compared."""
    found = [(i, form(line)) for i, line in enumerate(text.lower().split("\n")) if len(line) >= least]
    found = [(i, f) for i, f in found if len(f) >= least]
    return [i for i, _ in found], [f for _, f in found]


def sketch(docs: DataFrame, least: int = MIN_CHARS, shingle: int = SHINGLE) -> DataFrame:
    """docs: _place, text.  A row for each line that is compared; again: its form was in an earlier line of the text."""

    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("lines", dict)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                places, numbers, lines, again = [], [], [], []
                for place, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    at, own = forms(text, least)
                    places += [place] * len(at)
                    numbers += at
                    lines += own
                    seen: set[str] = set()
                    again += [x in seen or seen.add(x) is not None for x in own]
                for a, b in units(lines):
                    digest = np.frombuffer(b"".join([blake2b(x.encode(), digest_size=16).digest() for x in lines[a:b]]), dtype="<i8").reshape(-1, 2)
                    have = np.array([len(x) >= shingle for x in lines[a:b]])
                    wide = [x for x in lines[a:b] if len(x) >= shingle]
                    keys = np.zeros((0, BANDS), dtype=np.uint64)
                    if wide:
                        doc, h = char_shingles(wide, shingle)
                        keys = bands(one_permutation(doc, h, len(wide), ROWS * BANDS), ROWS)
                    offsets = np.concatenate([[0], np.cumsum(have)]).astype(np.int32) * BANDS
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys).ravel()), mask=pa.array(~have))
                    yield pa.RecordBatch.from_arrays([pa.array(places[a:b], pa.int64()), pa.array(numbers[a:b], pa.int32()), pa.array(again[a:b], pa.bool_()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], schema=_LINES)

    source = docs.where("text is not null").select(F.col("_place").alias("place"), "text")
    return source.mapInArrow(run, "place bigint, line int, again boolean, one bigint, two bigint, bands array<bigint>")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, scratch: common.Scratch) -> DataFrame:
    """wanted: node.  (node, text) of their lines."""
    at = nodes.join(wanted, "node").groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("line", "node"))).alias("at"))  # a document's own lines
    at = common.sized(scratch.stored(at, "line-places"), ROWS_BROADCAST)
    held = docs.where("text is not null").select(F.col("_place").alias("place"), "text").join(at, "place")
    # only wanted lines leave the array, so that no whole text is copied to each of them
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.try_element_at("at", i).alias("node"), x.alias("text")))
    return held.select(F.inline(F.filter(lines, lambda x: x["node"].isNotNull())))


def elements(shingle: int) -> links.Elements:
    return lambda lines: char_shingles([form(x.lower()) for x in lines], shingle)


def dropped(docs: DataFrame, scratch: common.Scratch, least: int = MIN_CHARS, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs: _place, text.  (place, lines): the numbers of the lines that go, for each row that loses some."""
    lines = scratch.stored(sketch(docs, least, shingle), "line-sketches")
    # equal digests have equal bands; a form is once at most in a document
    groups = lines.where("not again").groupBy("one", "two", "bands").agg(F.min("place").alias("place"), F.min_by("line", "place").alias("line"), F.count("*").alias("n"))
    # ids are fixed by being written
    nodes = scratch.stored(groups.withColumn("node", F.monotonically_increasing_id()), "line-nodes")
    found = links.classes(nodes.where("bands is not null").select("node", "bands"), lambda wanted: texts_of(docs, nodes, wanted, scratch), elements(shingle), similarity)
    # forms that occur once and have no link stay as they are
    rooted = nodes.drop("bands").join(common.sized(found), "node", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "node"))
    linked = rooted.groupBy("root").agg(F.min(F.struct("place", "line")).alias("stays"), F.count("*").alias("nodes"), F.max("n").alias("copies")).where("nodes > 1 or copies > 1").select("root", "stays")
    keep = common.sized(scratch.stored(rooted.join(linked, "root").select("one", "two", "stays"), "line-keeps"), ROWS_BROADCAST)
    gone = lines.where("not again").select("one", "two", "place", "line").join(keep, ["one", "two"]).where(F.struct("place", "line") != F.col("stays"))
    gone = gone.select("place", "line").union(lines.where("again").select("place", "line"))
    return gone.groupBy("place").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # a document's own lines


def dedup(docs: DataFrame, **settings) -> DataFrame:
    """docs with the text that stays, and the columns n_lines and dropped (line numbers from 0), to which columns of these names give way."""
    docs, back = common.apart(docs, ("doc_id", "text"), ("n_lines", "dropped"))
    docs = common.placed(docs)
    scratch = common.Scratch(docs.sparkSession)
    gone = common.stored(dropped(docs, scratch, **settings), "line-drops").select(F.col("place").alias("_place"), F.col("lines").alias("dropped"))
    scratch.drop()
    joined = docs.join(common.sized(gone, ROWS_BROADCAST), "_place", "left").drop("_place")
    rest = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i))
    out = joined.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)))
    left = F.when(F.col("dropped").isNotNull(), F.array_join(rest, "\n")).otherwise(F.col("text"))
    return back(out.withColumn("text", left).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>"))))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents."""
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", "text")
