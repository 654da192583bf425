"""A corpus pipeline: each stage takes the documents that its predecessor kept.

``STAGES`` are applied in order, each result written as Parquet to the shared
folder and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, lines, mixing, neardup, packing, toxicity


def _alone(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns that no stage reads under names of their own, and the way back to the columns of docs."""
    held, back = common.apart(docs, ("doc_id", "text", "lang", "source", "n_chars"))
    return held, lambda out: back(out.select(*held.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half and more go."""
    docs, back = _alone(docs)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return back(toxicity.score(docs, model, "toxicity").where("toxicity < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays; a document without any line left goes, unless it had none."""
    docs, back = _alone(docs)
    out = lines.dedup(docs)
    kept = out.where((F.size("dropped") == 0) | (F.length(F.trim("text")) > 0))
    return back(kept.withColumn("n_chars", F.when(F.size("dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    docs, back = _alone(docs)
    return back(neardup.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat, up to twice; no document is lost."""
    docs, back = _alone(docs)
    return back(mixing.draw(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    import public_tokenizers

    # workers that earlier stages have used leave less room for the encoder's cache
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most_chunks=100_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express signatures, classifiers or tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
