"""Token-id output: shards of independent zstandard frames with a trailing seek table.

A shard file is::

    frame 0 | frame 1 | ... | seek table | footer

* a frame is one zstandard frame over the little-endian uint32 ids of one run
  of documents (about ``FRAME_IDS`` ids; a longer document has a frame alone);
* the seek table is a zstandard skippable frame.  Its payload has, for each
  frame, ``offset u64, size u32, ids u64, documents u32, crc32 u32`` (the crc of
  the decompressed ids) and then, for each document, ``doc_id i64, ids u64``;
* the footer is ``payload length u64, frames u32, documents u32, crc32 of the
  payload u32, magic b"TSKT"``.

Any zstandard reader can decompress the frames; a reader of single documents
reads the footer, the seek table and the frames that it needs, and checks their
crc.  Shards are ranges of doc_id in ascending order; each is written under a
name of its attempt and then renamed, so a task that runs twice leaves one file.

Rows: a null text has no ids but its end id; a null doc_id is left out of the
files (it has no place in the order) ; rows with one doc_id follow each other in
the order of their text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import common
from .wordcache import MAX_CHUNKS, ChunkEncoder

#: Ids in a frame, unless one document alone has more.
FRAME_IDS = 1 << 18
LEVEL = 3
_FRAME = struct.Struct("<QIQII")
_DOC = np.dtype([("doc_id", "<i8"), ("ids", "<u8")])
_FOOT = struct.Struct("<QIII4s")
_MAGIC = b"TSKT"
_SKIP = 0x184D2A5E

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])

def encoder(path: str, most: int = MAX_CHUNKS) -> ChunkEncoder:
    return common.worker_cache(("encoder", path, most), lambda: ChunkEncoder(path, most))


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else uri)


class ShardWriter:
    """Frames go to the file as they fill; what stays in memory is one frame and the seek table."""

    def __init__(self, out):
        import zstandard

        self.out, self.z = out, zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.frames, self.docs, self.held, self.n = 0, [], [], [], 0
        self.in_frame = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.n and self.n + len(ids) > FRAME_IDS:
            self.flush()
        self.held.append(ids)
        self.n += len(ids)
        self.in_frame += 1
        self.docs.append((doc_id, len(ids)))

    def flush(self) -> None:
        if self.in_frame:
            raw = np.concatenate(self.held).astype("<u4").tobytes()
            data = self.z.compress(raw)
            self.out.write(data)
            self.frames.append(_FRAME.pack(self.at, len(data), self.n, self.in_frame, zlib.crc32(raw)))
            self.at += len(data)
            self.held, self.n, self.in_frame = [], 0, 0

    def close(self) -> None:
        self.flush()
        payload = b"".join(self.frames) + np.array(self.docs, dtype=_DOC).tobytes()
        foot = _FOOT.pack(len(payload), len(self.frames), len(self.docs), zlib.crc32(payload), _MAGIC)
        self.out.write(struct.pack("<II", _SKIP, len(payload) + len(foot)) + payload + foot)


class ShardReader:
    """Reads the frames that hold the wanted documents, and no others."""

    def __init__(self, source):
        self.f = source
        end = source.seek(0, 2)
        source.seek(end - _FOOT.size)
        length, frames, docs, crc, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        source.seek(end - _FOOT.size - length)
        payload = source.read(length)
        if zlib.crc32(payload) != crc:
            raise ValueError("the seek table is damaged")
        self.frames = [_FRAME.unpack_from(payload, i * _FRAME.size) for i in range(frames)]
        self.docs = np.frombuffer(payload, dtype=_DOC, offset=frames * _FRAME.size)
        self.frames_read = 0

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids of this shard before it, its ids), in file order."""
        import zstandard

        z = zstandard.ZstdDecompressor()
        doc, before = 0, 0
        for offset, size, n, docs, crc in self.frames:
            own = self.docs[doc : doc + docs]
            if wanted is None or not wanted.isdisjoint(own["doc_id"].tolist()):
                self.f.seek(offset)
                raw = z.decompress(self.f.read(size), max_output_size=max(1, 4 * n))
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"the frame at {offset} is damaged")
                self.frames_read += 1
                ids, at = np.frombuffer(raw, dtype="<u4"), 0
                for d, k in zip(own["doc_id"].tolist(), own["ids"].tolist()):
                    if wanted is None or d in wanted:
                        yield d, before + at, ids[at : at + k]
                    at += k
            doc, before = doc + docs, before + n


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write shards in ascending doc_id order; returns a manifest row for each shard."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    ordered = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", common.text_of().alias("text"))
        .repartitionByRange(common.partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        enc, writer, out, first, last, total = encoder(tokenizer), None, None, None, None, 0
        tmp = f"{base}/_{uuid.uuid4().hex}.tmp"
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids_of), 512):
                part = texts.slice(a, 512).to_pylist()
                for doc_id, ids in zip(ids_of[a : a + 512], enc.encode(part)):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(tmp)
                        writer, first = ShardWriter(out), doc_id
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
                    last, total = doc_id, total + len(ids) + 1
        if writer is not None:
            from pyspark import TaskContext

            writer.close()
            out.close()
            name = f"{base}/shard-{TaskContext.get().partitionId():06d}.ids"
            fs.move(tmp, name)
            uri = folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_pylist([{"path": uri, "first_doc": first, "last_doc": last, "docs": len(writer.docs), "ids": total}], schema=_MANIFEST_ARROW)

    return common.cut(ordered.mapInArrow(shard, MANIFEST))


_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])


def with_starts(manifest: DataFrame) -> DataFrame:
    """The ids in all shards before each; a manifest has one row for each shard, so it's small."""
    w = Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(w), F.lit(0)))


def read(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with wanted, only its shards are opened and only its frames decompressed."""
    spark = manifest.sparkSession
    shards = with_starts(manifest)
    if wanted is not None:
        shards = shards.where(F.exists(F.array(*[F.lit(int(d)) for d in wanted]) if wanted else F.array().cast("array<bigint>"), lambda d: d.between(F.col("first_doc"), F.col("last_doc"))))
    shards = shards.select("path", "start").repartition(common.partitions(spark), "path")
    keep = None if wanted is None else frozenset(map(int, wanted))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _fs(row["path"])
                rows, size = [], 0
                with fs.open_input_file(path) as f:
                    for doc_id, before, ids in ShardReader(f).read(keep):
                        rows.append({"doc_id": doc_id, "start": row["start"] + before, "n_tokens": len(ids), "ids": ids.tobytes()})
                        size += ids.nbytes
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return shards.mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


_READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back and digest what was read."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    manifest = write(docs, common.new_folder(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
