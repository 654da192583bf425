"""Packing of documents into training sequences by first-fit decreasing.

Documents are dealt at random into groups (a random partition, and within it
runs of about ``GROUP_TOKENS`` tokens in random order).  In each group every
document gives its full pieces of ``width`` tokens, which fill sequences of
their own, and a rest; the rests go, longest first, each to the first open
sequence with room, found in O(log n) in a tournament tree of free capacities.
Then the group's emptiest sequences are taken apart as long as the free space
of the others can hold their pieces, cut where a gap ends: a group's sequences
have less free space than one sequence.  A group never leaves its task, so memory
is that of one group.

Rows: a null or empty text is a document of its end id alone; repeated rows are
packed each; a null doc_id is packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_files import encoder
from .wordcache import MAX_CHUNKS

WIDTH = 2048
#: Tokens of a group; a longer document is a group of its own.
GROUP_TOKENS = 1 << 21


class CapacityTree:
    """A tournament of bins: each node knows the largest free capacity below it."""

    def __init__(self, bins: int, width: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.top = [width] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The leftmost bin with room for need; takes it."""
        i = 1
        top = self.top
        while i < self.leaves:
            i *= 2
            if top[i] < need:
                i += 1
        top[i] -= need
        found = i - self.leaves
        while i > 1:
            i //= 2
            best = max(top[2 * i], top[2 * i + 1])
            if top[i] == best:
                break
            top[i] = best
        return found


def first_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of item numbers; items are at most width long."""
    tree, bins = CapacityTree(len(lengths), width), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.place(lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack_group(lengths: list[int], width: int = WIDTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths."""
    full = [[(d, s, width)] for d, n in enumerate(lengths) for s in range(0, n - width + 1, width)]
    rest = [(d, n - n % width, n % width) for d, n in enumerate(lengths) if n % width]
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], width)]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (used[b], b))  # the emptiest first
    free = sum(width - u for u in used)
    gone = 0
    while gone < len(order) and free - (width - used[order[gone]]) >= used[order[gone]]:
        b = order[gone]
        gone += 1
        free -= width
        todo, k = bins[b], len(order) - 1
        bins[b] = []
        for d, s, n in todo:  # the fullest gaps first
            while n:
                while used[order[k]] == width:
                    k -= 1
                take = min(n, width - used[order[k]])
                bins[order[k]].append((d, s, take))
                used[order[k]] += take
                s, n = s + take, n - take
    return full + [b for b in bins if b]


def padded(length: int, width: int = WIDTH) -> int:
    """A sequence stays as it is at a power of two; otherwise it's filled to width."""
    return length if length & (length - 1) == 0 else width


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = WIDTH, group_tokens: int = GROUP_TOKENS, seed: int = 7, most_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Pieces with their ids (little-endian uint32); sequence_id is unique, not dense.  most_chunks bounds the encoder's memory, not the result."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_of().alias("text"))
    # by number, so no key can gather rows; sorted, so that a task that runs again forms the same groups
    dealt = dealt.repartition(common.partitions(spark)).withColumn("_order", order).sortWithinPartitions("_order", "doc_id", "text").drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, sequence = encoder(tokenizer, most_chunks), TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close():
            nonlocal sequence
            rows = []
            for pieces in pack_group([len(ids) for _, ids in held], width):
                offset = 0
                for d, s, n in pieces:
                    doc_id, ids = held[d]
                    rows.append((doc_id, s, n, ids[s : s + n].tobytes(), len(ids), sequence, offset))
                    offset += n
                sequence += 1
                if len(rows) >= 4096:
                    yield rows
                    rows = []
            if rows:
                yield rows

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids_of), 512):
                for doc_id, ids in zip(ids_of[a : a + 512], enc.encode(texts.slice(a, 512).to_pylist())):
                    if held and size + len(ids) + 1 > group_tokens:
                        yield from map(out, close())
                        held, size = [], 0
                    held.append((doc_id, np.append(ids, np.uint32(end_id)).astype("<u4")))
                    size += len(ids) + 1
        if held:
            yield from map(out, close())

    return dealt.mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    import public_tokenizers

    return digest(pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
