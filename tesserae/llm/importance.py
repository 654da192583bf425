"""Target-distribution importance resampling over hashed n-grams.

Features are runs of 1 to ``n`` consecutive words, repeats counted; a feature's
bucket is the crc32 of its words joined by one space, modulo ``buckets``.  A
document's weight is the mean log ratio of its buckets between a target corpus
and the documents, and documents are drawn without replacement by the largest
sums of weight and Gumbel noise (seeded by their id).

No n-gram is ever spelled out: a CRC is linear over GF(2), so the crc of two
strings in a row is the first one's, moved by the length of the second, xor the
second one's.  Moving by 2**k bytes is one 32 by 32 bit matrix, and a length's
bits say which matrices to apply.  Each word's crc is taken once; those of longer
runs are made from it in numpy, for all runs of a batch at once.

Counts of buckets are summed inside tasks, so the shuffle has a row for each
bucket and task; the gains (a row for each of ``buckets``, a parameter) go to
all tasks.  Ranks are counted over ranges, not in one task.

Rows: a null or empty text has no words, weight 0 and no rank; a null doc_id
draws noise like an empty id and loses ties; repeated rows count and are drawn each;
rows that tie in score and doc_id come by n_features; without documents or target texts
counts are zero.  Only doc_id and text of the input are read, so other columns
can't clash.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import ranks

from . import common

BUCKETS = 10_000
#: Documents of fewer words aren't drawn; share of the others that is, in percent.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Words whose runs are worked on at once.
UNIT_WORDS = 1 << 18

_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_SPACED = bytes(c if c >= 0x80 or chr(c) in string.ascii_lowercase + string.digits else _LOWER[_UPPER.index(c)] if c in _UPPER else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased: every byte from 0x80 on is part of a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def _square(m: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, as the images of the 32 single bits, applied twice."""
    bits = (m[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits == 1, m[None, :], np.uint32(0)), axis=1)


class Shifts:
    """Moves crcs by numbers of bytes; one matrix for each power of two, held as four tables of 256 images."""

    def __init__(self) -> None:
        one_bit = np.concatenate([np.array([0xEDB88320], dtype=np.uint32), np.uint32(1) << np.arange(31, dtype=np.uint32)])
        self.last = _square(_square(_square(one_bit)))  # eight bits are one byte
        self.tables: list[np.ndarray] = []

    def table(self, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            bytes_ = np.arange(256, dtype=np.uint32)
            images = np.zeros((4, 256), dtype=np.uint32)
            for part in range(4):
                for bit in range(8):
                    images[part] ^= np.where((bytes_ >> bit) & 1 == 1, self.last[8 * part + bit], np.uint32(0))
            self.tables.append(images)
            self.last = _square(self.last)
        return self.tables[k]

    def move(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each crc, moved by its length."""
        for k in range(int(length.max(initial=0)).bit_length()):
            t = self.table(k)
            moved = t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]
            crc = np.where((length >> k) & 1 == 1, moved, crc)
        return crc


def feature_crcs(docs: list[list[bytes]], n: int, shifts: Shifts) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, crc32) of each run of 1 to n words of each document."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), size)
    words = [w for d in docs for w in d]
    crc = np.array(list(map(zlib.crc32, words)), dtype=np.uint32)
    if n == 1:
        return doc, crc
    length = np.array(list(map(len, words)), dtype=np.int64)
    spaced = shifts.move(np.full(len(words), zlib.crc32(b" "), dtype=np.uint32), length) ^ crc  # of a blank and the word
    left = np.repeat(np.cumsum(size), size) - np.arange(len(words))  # words from here to the document's end
    at, runs = np.arange(len(words)), crc
    all_docs, all_crcs = [doc], [crc]
    for k in range(1, n):
        on = left[at] > k
        at, runs = at[on], runs[on]
        runs = shifts.move(runs, 1 + length[at + k]) ^ spaced[at + k]
        all_docs.append(doc[at])
        all_crcs.append(runs)
    return np.concatenate(all_docs), np.concatenate(all_crcs)


def _units(texts: list[str | None], n: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, end, its words) of runs of rows of about UNIT_WORDS words."""
    start, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        total += len(held[-1])
        if total >= UNIT_WORDS or i == len(texts) - 1:
            yield start, i + 1, held
            start, held, total = i + 1, [], 0


def counts(docs: DataFrame, n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all texts: how many features each bucket holds; buckets without any have no row."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, total = Shifts(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, words in _units(batch.column(0).to_pylist(), n):
                total += np.bincount(feature_crcs(words, n, shifts)[1] % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio between target and documents, one for each bucket, each count with one added."""
    spark = docs.sparkSession
    s = common.cut(counts(docs, n, buckets)).withColumnRenamed("n", "s")
    t = common.cut(counts(target, n, buckets)).withColumnRenamed("n", "t")
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    rows = both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(up / down) * 1000).alias("gain"))  # one row of totals
    return [r.gain for r in rows.orderBy("bucket").collect()]  # a row for each bucket, a parameter


def weigh(docs: DataFrame, gain: list[int], n: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    common.bound_batches(docs.sparkSession)
    table = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in _units(batch.column(1).to_pylist(), n):
                doc, crc = feature_crcs(words, n, shifts)
                many = np.bincount(doc, minlength=b - a)
                total = np.zeros(b - a, dtype=np.int64)
                np.add.at(total, doc, table[crc % np.uint32(len(table))])
                size = np.array([len(w) for w in words], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size), pa.array(many), pa.array(total // np.maximum(many, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: str) -> F.Column:
    """Thousandths of a draw from the Gumbel distribution that the id alone decides."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, and the rank of the rows that are drawn: percent of those of least_words words."""
    weighed = common.stored(weigh(docs, gains(docs, target, n, buckets), n), "weighed")  # ranges are sampled before they are dealt
    scored = weighed.withColumn("score", F.col("weight") + noise(seed)).withColumn("long_enough", F.col("n_words") >= least_words)
    rows = ranks.numbered(scored, [F.desc("long_enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    drawn = rows.agg(F.floor(F.count_if("long_enough") * percent / 100).alias("drawn"))
    rank = F.when(F.col("long_enough") & (F.col("number") <= F.col("drawn")), F.col("number"))
    return rows.crossJoin(F.broadcast(drawn)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))  # one row


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents towards the texts of benchmark."""
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return resample(docs, target, n=1)


#: crc32 of each different word, byte by byte through the table of its polynomial.
SQL = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT doc_id, true AS is_doc, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents
  UNION ALL SELECT NULL, false, coalesce(text, ''), -row_number() OVER () FROM benchmark),
words AS (
  SELECT row, doc_id, is_doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
counted AS (SELECT row, is_doc, w, count(*) AS n FROM words GROUP BY 1, 2, 3),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table),
per_bucket AS (
  SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM counted JOIN hashed USING (w) GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM per_bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM per_bucket, totals),
sums AS (SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS total FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) WHERE is_doc GROUP BY 1),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h
  FROM texts LEFT JOIN sums USING (row) WHERE is_doc),
scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000.0 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM ranked
"""
