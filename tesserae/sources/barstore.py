"""Bars as a stored table: partitions by time, buckets by code.

Price windows, as-of joins and groupings by code read it without an exchange, since
all bars of a code are in one bucket, and a read of the last days opens only the
partitions of these days.  A table is derived once for what it is made from (names,
sizes and times of the input's files are in its name) and kept for the session in
the folder that driver and executors share.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.shared import new_folder

#: Day bars lie in partitions of a year, minute bars in partitions of a day.
UNITS = {"day": ("year", lambda t: F.year(t)), "minute": ("day", lambda t: F.to_date(t))}


def made_from(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files of these tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        for s in at.getFileSystem(conf).listStatus(at):
            found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def dealt(rows: DataFrame) -> DataFrame:
    """rows: code, and more.  Dealt by code into as many parts as a table has buckets: what is grouped by code and time out of them is in its bucket already."""
    return rows.repartition(_buckets(rows.sparkSession), "code")


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(bars: DataFrame, name: str, kind: str, time: str, buckets: int) -> None:
    """bars: code, a time, and more, made of rows that were ``dealt``.  One file for each partition and bucket."""
    part, of = UNITS[kind]
    bars.withColumn(part, of(F.col(time))).write.partitionBy(part).bucketBy(buckets, "code").sortBy("code", time).option("path", new_folder(bars.sparkSession, name)).saveAsTable(name)


def table_of(bars: DataFrame, kind: str, time: str, digest: str) -> DataFrame:
    """The stored table of bars (made of rows that were ``dealt``), written if this session hasn't got it."""
    spark = bars.sparkSession
    buckets = _buckets(spark)
    name = f"{kind}_bars_{digest}_{buckets}"
    if not spark.catalog.tableExists(name):
        write(bars, name, kind, time, buckets)
    return spark.table(name)


def since(bars: DataFrame, kind: str, time: str, first: dt.datetime | dt.date) -> DataFrame:
    """Bars from a time on; older partitions aren't opened."""
    part, of = UNITS[kind]
    return bars.where((F.col(part) >= of(F.lit(first))) & (F.col(time) >= F.lit(first)))


def last_days(bars: DataFrame, kind: str, time: str, days: int, now: dt.datetime) -> DataFrame:
    return since(bars, kind, time, now - dt.timedelta(days=days))


def latest(bars: DataFrame, kind: str, time: str) -> dt.datetime | dt.date | None:
    """The newest bar's time, from the newest partition alone."""
    part, _ = UNITS[kind]
    top = bars.agg(F.max(part).alias("p")).head()["p"]  # by file statistics of a partition column
    return None if top is None else bars.where(F.col(part) == F.lit(top)).agg(F.max(time).alias("t")).head()["t"]


def ordered(bars: DataFrame, time: str, columns: list[Column | str]) -> DataFrame:
    """Series in order of code and time; each bucket is sorted on its own."""
    return bars.select("code", time, *columns).sortWithinPartitions("code", time)
