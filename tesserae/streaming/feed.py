"""A feed of ticks as a streaming source.

A feed is a folder of numbered segments of lines in numbered partitions
(``part=0/segment=12/``), as a collector of a socket leaves them: a segment is complete
when it appears, and never changes.  The source's offset is the number of segments read in each
partition, so a restart from a checkpoint goes on where it stopped; a batch is one task
for each partition that has new segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "part int, segment int, line int, value string"
_SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("line", pa.int32()), ("value", pa.string())])


def _open(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def segments(folder: str) -> dict[int, list[int]]:
    """The numbers of the segments of each partition, ascending."""
    from pyarrow import fs

    system, path = _open(folder)
    out: dict[int, list[int]] = {}
    for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        found = re.search(r"part=(\d+)/segment=(\d+)$", f.path)
        if found and f.type == fs.FileType.Directory:
            out.setdefault(int(found[1]), []).append(int(found[2]))
    return {p: sorted(s) for p, s in out.items()}


@dataclass
class Span(InputPartition):
    part: int
    numbers: list[int]

    def __init__(self, part: int, numbers: list[int]):
        super().__init__(part)
        self.part, self.numbers = part, numbers


class Feed(DataSource):
    """format("feed"): the lines of a folder's segments, with their places."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options["path"], int(self.options.get("segments", 1 << 30)))


class FeedReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.given = folder, most, None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What is there; at most a stated number of segments more in each partition than the last time."""
        there = {str(p): len(s) for p, s in segments(self.folder).items()}
        if self.given is not None:
            there = {p: min(n, self.given.get(p, 0) + self.most) for p, n in there.items()}
        self.given = there
        return there

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.given = dict(end)
        there = segments(self.folder)
        return [Span(int(p), there[int(p)][start.get(p, 0) : n]) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = _open(self.folder)
        for segment in partition.numbers:
            files = system.get_file_info(fs.FileSelector(f"{path}/part={partition.part}/segment={segment}"))
            line = 0
            for f in sorted(x.path for x in files if x.is_file and not x.base_name.startswith(("_", "."))):
                with system.open_input_stream(f) as stream:
                    rest = b""
                    while block := stream.read(1 << 20):
                        *whole, rest = (rest + block).split(b"\n")
                        yield self._batch(partition.part, segment, line, whole)
                        line += len(whole)
                    if rest:
                        yield self._batch(partition.part, segment, line, [rest])
                        line += 1

    @staticmethod
    def _batch(part: int, segment: int, line: int, values: list[bytes]) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(range(line, line + n), pa.int32()), pa.array([v.decode("utf-8", "replace") for v in values])], schema=_SCHEMA)

    def commit(self, end: dict) -> None:
        pass


def read(spark: SparkSession, folder: str, segments_at_once: int | None = None) -> DataFrame:
    """The lines of a feed as a stream."""
    spark.dataSource.register(Feed)
    reader = spark.readStream.format("feed").option("path", folder)
    return (reader.option("segments", segments_at_once) if segments_at_once else reader).load()


def publish(lines: DataFrame, folder: str) -> None:
    """lines: part, segment, order, value.  Writes each segment in its order."""
    dealt = lines.repartition("part", "segment").sortWithinPartitions("part", "segment", "order")
    dealt.select("part", "segment", "value").write.partitionBy("part", "segment").mode("append").text(folder)
