"""Streams that stop and go on, and containers, against what is there at once."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tesserae.operators.shared import new_folder
from tesserae.sources import containers
from tesserae.streaming import feed, spool


def lines_of(spark, n, first=0):
    return spark.createDataFrame([(i % 3, (i // 30) + 1, i, f"line {i} é") for i in range(first, first + n)], "part int, segment int, order int, value string")


def test_feed_restarts_without_loss(spark):
    folder, failed = new_folder(spark, "feed"), []

    def run(fail_at=None):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            if number == fail_at and not failed:
                failed.append(number)
                raise RuntimeError("after the write")

        feed.read(spark, f"{folder}/in", 2).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()

    feed.publish(lines_of(spark, 120), f"{folder}/in")
    run()
    feed.publish(lines_of(spark, 90, 120), f"{folder}/in")
    with pytest.raises(StreamingQueryException):
        run(1)
    run()
    run()
    run()
    got = spark.read.parquet(f"{folder}/out").collect()
    assert failed == [1] and sorted(r.value for r in got) == sorted(f"line {i} é" for i in range(210))
    places = [(r.part, r.segment, r.line) for r in got]
    assert len(set(places)) == 210
    for r in got:  # in order inside a segment
        assert int(r.value.split()[1]) == [i for i in range(210) if i % 3 == r.part and i // 30 + 1 == r.segment][r.line]


def test_feed_offsets(spark):
    folder = new_folder(spark, "feed")
    reader = feed.FeedReader(folder, 2)
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    feed.publish(lines_of(spark, 120), folder)
    assert reader.latestOffset() == {"0": 2, "1": 2, "2": 2} and reader.latestOffset() == {"0": 4, "1": 4, "2": 4}
    assert [(s.part, s.numbers) for s in reader.partitions({"0": 1, "1": 4}, {"0": 3, "1": 4, "2": 1})] == [(0, [2, 3]), (2, [1])]


SCHEMA = "id bigint, key string"


def put(spark, folder, rows):
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")


def test_spool_inserts_each_key_once(spark):
    folder = new_folder(spark, "spool")

    def run(hook=lambda b: None):
        spool.insert_once(spool.lines(spark, f"{folder}/in", SCHEMA), f"{folder}/t", "key", "id", before_ledger=hook)

    def boom(batch):
        raise RuntimeError("no ledger")

    put(spark, folder, ['{"id": 5, "key": "a"}', '{"id": 2, "key": "a"}', '{"id": 3, "key": null}', "{broken", '{"id": 1, "key": "b"}'])
    run()
    put(spark, folder, ['{"id": 0, "key": "a"}', '{"id": 7, "key": "c"}', "also broken}"])
    for _ in range(2):  # it breaks off twice; nothing of it counts
        with pytest.raises(StreamingQueryException):
            run(boom)
        assert {(r.id, r.key) for r in spool.rows(spark, f"{folder}/t", SCHEMA).collect()} == {(2, "a"), (1, "b"), (3, None)}
    run()
    run()
    assert sorted((r.id, r.key or "") for r in spool.rows(spark, f"{folder}/t", SCHEMA).collect()) == [(1, "b"), (2, "a"), (3, ""), (7, "c")]
    assert sorted(r.line for r in spool.aside(spark, f"{folder}/t").collect()) == ["also broken}", "{broken"]
    assert sorted(map(tuple, spool.ledger(spark, f"{folder}/t").select("batch", "inserted", "repeated", "aside").collect())) == [(0, 3, 1, 1), (1, 1, 1, 1)]


def test_nothing_spooled(spark):
    folder = new_folder(spark, "spool")
    assert spool.rows(spark, folder, SCHEMA).collect() == [] and spool.aside(spark, folder).collect() == [] and spool.ledger(spark, folder).collect() == []


def container(files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return held.getvalue()


def test_containers_as_binary_files(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(container({"a.xml": "main", "a_00761.xml": '<?xml version="1.0" encoding="euc-kr"?>연결'.encode("euc-kr"), "a_00760.xml": "별도".encode("euc-kr"), "x.txt": "no"}))
    (tmp_path / "b.zip").write_bytes(container({"b.xml": "only é"}))
    (tmp_path / "c.zip").write_bytes(b"no container")
    (tmp_path / "d.zip").write_bytes(container({"d_00760.xml": "left"}))
    files = containers.unpack(containers.read(spark, f"file://{tmp_path}"), "path")
    got = {(r.path[-5], r.scope, r.body) for r in containers.statements(files, "path").collect()}
    assert got == {("a", "consolidated", '<?xml version="1.0" encoding="euc-kr"?>연결'), ("a", "separate", "별도"), ("b", "consolidated", "only é"), ("b", "separate", "only é"), ("d", "separate", "left")}
    nulls = spark.createDataFrame([(1, None), (2, bytearray())], "doc long, content binary")
    assert containers.unpack(nulls, "doc").collect() == []


def test_feed_items(spark):
    good = "<rss><channel><title>t</title><item><title> A &amp; B </title><link>l</link><source url='u'>S</source><pubDate>Tue, 02 Jan 2024 03:04:05 +0900</pubDate></item><item><link>x</link></item><item><title><![CDATA[<b>]]></title></item></channel></rss>"
    one = "<rss><channel><item><title>single</title><pubDate>never</pubDate></item></channel></rss>"
    df = spark.createDataFrame([(0, good), (1, one), (2, "no xml"), (3, None), (4, ""), (5, "<rss><channel></channel></rss>")], "i int, x string")
    got = {r.i: [tuple(x) for x in r.items or []] for r in df.select("i", containers.feed_items(F.col("x")).alias("items")).collect()}
    assert [t[:3] for t in got[0]] == [("A & B", "l", "S"), ("<b>", None, None)] and got[0][1][3] is None
    assert got[0][0][3] == datetime(2024, 1, 1, 18, 4, 5)
    assert got[1] == [("single", None, None, None)] and all(got[i] == [] for i in (2, 3, 4, 5))
