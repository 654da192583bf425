"""A spool of JSON lines into a table, each row once.

Each batch of the stream is one folder of rows, one of lines that can't be read, and one
line in the ledger, written last.  Only batches in the ledger count, so a batch that broke off is
written again in its place, and one that is in the ledger is passed over.  A row is inserted
if no batch of the ledger and no earlier row of its own batch has its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"
LEDGER = "batch bigint, inserted bigint, repeated bigint, aside bigint"


def lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a folder as they come; a line that can't be read is in the column _broken."""
    whole = T.StructType.fromDDL(schema).add(BROKEN, T.StringType())
    return spark.readStream.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(folder)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """batch, inserted, repeated, aside of each batch that was completed."""
    path = f"{folder}/ledger"
    return spark.read.schema(LEDGER).json(f"{path}/*") if _there(spark, path) else spark.createDataFrame([], LEDGER)


def _committed(spark: SparkSession, folder: str, what: str, schema: T.StructType | str) -> DataFrame:
    done = [r.batch for r in ledger(spark, folder).select("batch").collect()]  # numbers of batches
    paths = [p for b in sorted(done) if _there(spark, p := f"{folder}/{what}/batch={b}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rows(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    return _committed(spark, folder, "rows", schema)


def aside(spark: SparkSession, folder: str) -> DataFrame:
    """line: those that couldn't be read."""
    return _committed(spark, folder, "aside", "line string")


def insert_once(stream: DataFrame, folder: str, key: str, order: str, good: Callable[[DataFrame], DataFrame] = lambda df: df, before_ledger: Callable[[int], None] = lambda batch: None) -> None:
    """Inserts the rows of a stream of lines that are there now.

    good makes rows (with the key) out of readable lines.  Of equal keys in a batch the least by order is inserted.
    before_ledger is called when a batch has been written and isn't in the ledger yet.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if ledger(spark, folder).where(F.col("batch") == number).head() is not None:
            return
        batch = batch.persist()
        readable = good(batch.where(F.col(BROKEN).isNull()).drop(BROKEN))
        known = rows(spark, folder, readable.schema).select(key)
        first = readable.groupBy(key).agg(F.min_by(F.struct(*readable.columns), order).alias("r")).select("r.*")
        first.join(known, key, "left_anti").select(*readable.columns).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line")).write.mode("overwrite").parquet(f"{folder}/aside/batch={number}")
        inserted = spark.read.schema(readable.schema).parquet(f"{folder}/rows/batch={number}").count()
        broken = spark.read.schema("line string").parquet(f"{folder}/aside/batch={number}").count()
        counted = (number, inserted, readable.count() - inserted, broken)
        batch.unpersist()
        before_ledger(number)
        spark.createDataFrame([counted], LEDGER).coalesce(1).write.mode("overwrite").json(f"{folder}/ledger/at={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
