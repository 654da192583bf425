"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.shared import new_folder, shared_dir, stored

__all__ = ["new_folder", "shared_dir", "stored"]  # shared with the operators outside


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))



def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: the rows are in the shared folder, so a lost executor costs none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame, used: Iterable[str], made: Iterable[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the used ones under names that no operator uses, and the way back.

    Columns of the input with the name of a made one give way to it.
    """
    used, made = list(used), {c.lower() for c in made}
    kept = df.drop(*[c for c in df.columns if c.lower() in made and c not in used])
    names = {c: f"__other_{i}" for i, c in enumerate(kept.columns) if c not in used}
    return kept.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


class Scratch:
    """Tables of one computation in the shared folder, deleted together when what was made of them is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_folder(spark, "scratch")

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.path}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored frame of narrow rows: broadcast if it was counted to be small, joined by shuffle otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def placed(docs: DataFrame) -> DataFrame:
    """docs with _place, one for each row, ascending by doc_id (null last) and text."""
    n = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).head()
    if n["n"] == n["d"]:
        return docs.withColumn("_place", F.col("doc_id").cast("bigint"))
    # equal rows are dealt out by their number in the input
    numbered = docs.withColumn("_tie", F.monotonically_increasing_id())
    ordered = numbered.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last(), "_tie").drop("_tie")
    return stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "rows")


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python end at BATCH_BYTES too, not at a number of rows alone, so long texts don't add up; a session's own bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))


BATCH_BYTES = 4 << 20
_kept: dict[Any, Any] = {}


def release() -> None:
    """Memory that numpy and Arrow have freed goes back to the system, so a worker that waits for its next task holds little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker between tasks.  Workers outlive stages, so the next operator's cache replaces it."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number: the folds that labels are split by."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)).cast("int")
