"""Streams: tick bars, latest quotes, first-seen rows, a spool of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.shared import new_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    ntz = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else stream


def bars(ticks: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    )


def run_to_table(stream: DataFrame, key: list[str], what: str) -> DataFrame:
    """Everything that is there now, in update mode; a later version of a key overwrites the earlier ones."""
    spark = stream.sparkSession
    out, mark = new_folder(spark, what), new_folder(spark, f"{what}-mark")
    names = stream.columns

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/batch=*")
    rest = [c for c in names if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return newest.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("t"))


def first_seen(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within the lateness."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


SPOOL = "kind string, ref_date date, sent_at timestamp, title string, body string, stock_codes array<string>, industries array<string>, dedup_key string"
KINDS = ("morning", "midday", "closing", "evening")


def spool(spark: SparkSession, folder: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """JSON lines of a folder as they come; broken lines and unknown kinds are left out."""
    rows = spark.readStream.schema(SPOOL).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(F.col("kind").isin(*kinds) & F.col("ref_date").isNotNull())


def dedup_key(kind: str, date: str, body: str):
    """kind|date|first 12 hex digits of the body's digest."""
    return F.concat_ws("|", F.col(kind), F.col(date).cast("string"), F.left(F.sha2(F.col(body), 256), F.lit(12)))


def append_json(rows: DataFrame, folder: str, checkpoint: str):
    """Appends new rows of a stream to a folder of JSON lines, once each; returns when what is there has been written."""
    query = rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
