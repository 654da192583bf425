"""Containers of documents: zip files of XML, and feeds."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.texts import rfc822

#: The files of a container that hold the consolidated and the separate statements.
CONSOLIDATED, SEPARATE = "_00761.xml", "_00760.xml"
_CODES = ("utf-8", "euc-kr")
#: Characters after which a batch of files is handed on.
BATCH_CHARACTERS = 4_000_000


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the containers of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")


def decoded(raw: bytes) -> str:
    """By the encoding that the document names, else the first that fits."""
    named = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w-]+)", raw)
    for code in ((named[1].decode(),) if named else ()) + _CODES:
        try:
            return raw.decode(code)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def unpack(containers: DataFrame, key: str) -> DataFrame:
    """containers: key, content.  (key, name, body) of each XML file; what is no container has none."""
    kind = containers.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, content in enumerate(batch.column(1)):
                try:
                    held = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in held.namelist():
                    if name.endswith(".xml"):
                        try:
                            body = decoded(held.read(name))
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):  # damaged, locked or of another method
                            continue
                        out.append((i, name, body))
                        size += len(body)
                        if size >= BATCH_CHARACTERS:
                            yield batch_of(batch.column(0), out)
                            out, size = [], 0
            if out:
                yield batch_of(batch.column(0), out)

    def batch_of(keys: pa.Array, files: list[tuple[int, str, str]]) -> pa.RecordBatch:
        at, names, bodies = zip(*files)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(names), pa.array(bodies)], names=[key, "name", "body"])

    return containers.select(key, "content").mapInArrow(run, f"`{key}` {kind}, name string, body string")


def statements(files: DataFrame, key: str) -> DataFrame:
    """files: key, name, body.  key, scope, body: the file of each scope, else the main one."""
    which = F.when(F.endswith("name", F.lit(CONSOLIDATED)), "consolidated").when(F.endswith("name", F.lit(SEPARATE)), "separate").when(~F.col("name").rlike(r"_\d{5}\.xml$"), "main")
    held = files.withColumn("which", which).groupBy(key).agg(*[F.min_by("body", F.when(F.col("which") == w, F.col("name"))).alias(w) for w in ("consolidated", "separate", "main")])
    both = F.array(*[F.struct(F.lit(w).alias("scope"), F.coalesce(w, "main").alias("body")) for w in ("consolidated", "separate")])
    return held.select(key, F.inline(both)).where("body is not null")


FEED = "channel struct<title:string,item:array<struct<title:string,link:string,source:struct<_VALUE:string,_url:string>,pubDate:string>>>"


def feed_items(xml: Column) -> Column:
    """Items of a feed, read as XML: array of (title, link, source, published); items without a title are left out, and what is no XML has none."""
    items = F.from_xml(xml, FEED, {"mode": "PERMISSIVE"})["channel"]["item"]
    rows = F.transform(items, lambda x: F.struct(F.trim(x["title"]).alias("title"), F.trim(x["link"]).alias("link"), F.trim(x["source"]["_VALUE"]).alias("source"), rfc822(x["pubDate"]).alias("published")))
    return F.coalesce(F.filter(rows, lambda r: F.coalesce(r["title"], F.lit("")) != ""), F.filter(rows, lambda r: F.lit(False)))
