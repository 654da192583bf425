"""Queries through streams and containers: what comes in piece by piece must be what is there at once."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.shared import new_folder
from tesserae.plans import filings
from tesserae.sources import containers, grids, parsers
from tesserae.sources.views import table
from tesserae.streaming import feed, spool, ticks


def tick_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as frames of a feed of four partitions, segments of a day; read by a stream that stops in the middle of the month and goes on."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    day = F.dayofmonth("ts")
    fields = [F.col("user_id"), F.date_format("ts", "yyyyMMddHHmmss"), F.col("value"), F.lit(2), F.lit(0), F.col("event_id") % 7, *[F.lit(0)] * 7, F.col("event_id")]
    line = F.concat(F.lit("0|H0STCNT0|001|"), F.concat_ws("^", *[f.cast("string") for f in fields]))
    lines = e.select((F.col("user_id") % 4).cast("int").alias("part"), day.alias("segment"), F.col("event_id").alias("order"), line.alias("value"))
    folder = new_folder(spark, "feed")
    for days in (F.col("segment") <= 15, F.col("segment") > 15):
        feed.publish(lines.where(days), f"{folder}/in")
        query = feed.read(spark, f"{folder}/in").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
    got = parsers.frames(spark.read.schema(feed.LINES).parquet(f"{folder}/out"))
    return got.groupBy("code").agg(F.count("*").alias("n"), F.max_by("price", "volume").alias("price"), F.max("time").alias("time"), F.sum("change_pct").alias("change"))


TICK_FEED = "SELECT CAST(user_id AS VARCHAR) AS code, count(*) AS n, max_by(value, event_id) AS price, max(strftime(ts, '%Y%m%d%H%M%S')) AS time, CAST(sum(event_id % 7) AS DOUBLE) AS change FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1"

_SPOOL = "doc_id bigint, kind string, ref_date date, body string"


def spooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines in two lots, some twice and a tenth broken off; the second lot's first run fails before its ledger."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ticks.KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("ref_date"), F.coalesce("text", F.lit("")).alias("body"))
    line = F.to_json(F.struct("doc_id", "kind", "ref_date", "body"))
    line = F.when(F.col("doc_id") % 10 == 7, F.left(line, F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    folder = new_folder(spark, "spool")

    def run(before_ledger=lambda batch: None) -> None:
        keyed = lambda df: df.withColumn("dedup_key", ticks.dedup_key("kind", "ref_date", "body"))
        spool.insert_once(spool.lines(spark, f"{folder}/in", _SPOOL), f"{folder}/table", "dedup_key", "doc_id", keyed, before_ledger)

    def breaks(batch: int) -> None:
        raise RuntimeError("broken off before the ledger")

    d.where("doc_id % 2 = 0").select(line.alias("value")).write.mode("append").text(f"{folder}/in")
    run()
    d.where("doc_id % 2 = 1 or doc_id % 4 = 0").select(line.alias("value")).write.mode("append").text(f"{folder}/in")
    try:
        run(breaks)
    except StreamingQueryException:  # as planned; what follows takes the batch up again
        run()
    kept = spool.rows(spark, f"{folder}/table", f"{_SPOOL}, dedup_key string").select("doc_id", F.lit("inserted").alias("what"), "dedup_key")
    broken = spool.aside(spark, f"{folder}/table").select(F.regexp_extract("line", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"), F.lit("aside").alias("what"), F.lit(None).cast("string").alias("dedup_key"))
    return kept.unionByName(broken)


SPOOLED = f"""WITH d AS (SELECT doc_id, {list(ticks.KINDS)}[doc_id % 4 + 1] || '|' || strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') || '|' || left(sha256(coalesce(text, '')), 12) AS dedup_key FROM documents)
SELECT min_by(doc_id, (doc_id % 2, doc_id)) AS doc_id, 'inserted' AS what, dedup_key FROM d WHERE doc_id % 10 <> 7 GROUP BY dedup_key UNION ALL SELECT doc_id, 'aside', NULL FROM d WHERE doc_id % 10 = 7"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of all documents as items of XML feeds of a hundred at most, read back."""
    title = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0), r"[\x00-\x1F\x7F]+", " "))
    safe = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = F.timestamp_add("HOUR", (F.col("doc_id") % 4000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    item = F.concat(F.lit('<item><title>'), safe, F.lit("</title><link>http://x/"), F.col("doc_id").cast("string"), F.lit('</link><source url="u">'), F.col("source"), F.lit("</source><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900</pubDate></item>"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", title.alias("title")).select("source", F.floor(F.col("doc_id") / 100).alias("part"), item.alias("item"))
    feeds = d.groupBy("source", "part").agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("xml"))  # a hundred ids at most
    got = feeds.select(F.inline(containers.feed_items(F.col("xml"))))
    return got.select(F.regexp_extract("link", r"(\d+)$", 1).cast("long").alias("doc_id"), "title", "source", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"))


FEED_ITEMS = """SELECT doc_id, title, source, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 4000 - 9 AS INTEGER)), '%Y-%m-%d %H:%M') AS published
FROM (SELECT doc_id, source, trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\n]*', 0), '[\\x00-\\x1F\\x7F]+', ' ', 'g')) AS title FROM documents) WHERE title <> ''"""


def _zipped(filed: DataFrame) -> DataFrame:
    """doc, content: a container for each document; consolidated statements are in a file of their own, separate ones in the main file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{doc}.xml", "<P>see the other file</P>" if doc % 2 == 0 else body)
                    if doc % 2 == 0:
                        z.writestr(f"{doc}_00761.xml", body.encode("euc-kr"))
                    z.writestr("readme.txt", "x")
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "content"])

    return filed.select("doc", "body").mapInArrow(run, "doc bigint, content binary")


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in equity out of containers, summed for each document, scope and period."""
    bodies = containers.statements(containers.unpack(_zipped(filings.filed(spark, sf_dir)), "doc"), "doc")
    keyed = bodies.select((F.col("doc") * 2 + (F.col("scope") == "separate").cast("int")).alias("doc"), "body")
    got = grids.equity_changes(keyed).where((F.col("doc") % 2 == 1) == (F.col("scope") == "separate"))
    return got.groupBy(F.floor(F.col("doc") / 2).alias("doc"), "scope", "ends").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


CONTAINED = f"SELECT doc, scope, ends, count(*) AS n, sum(amount) AS amount FROM ({filings.EQUITY}) GROUP BY 1, 2, 3"

QUERIES = {"s18_tick_feed": tick_feed, "t3_s15_s16_spool": spooled, "s7_feed_items": feed_items, "s11_containers": contained}
ORACLES = {"s18_tick_feed": TICK_FEED, "t3_s15_s16_spool": SPOOLED, "s7_feed_items": FEED_ITEMS, "s11_containers": CONTAINED}
