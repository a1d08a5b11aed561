"""A streaming source over the lines of a growing capture file, with byte offsets that can be read again.

A decoder writes to a pipe, which forgets what was read; `spool` appends its lines to a file in a shared folder, and the
source reads that file. An offset is the byte behind the last whole line, so a line still being written is never seen
in half, and a restarted stream goes on where its checkpoint says. A batch is split into byte ranges that the tasks
read side by side; a range has the lines that begin in it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from traceweave.sources.scan import decoded_packets, split_decoded_line
from traceweave.streaming.live import with_event_time

#: Bytes that one task reads of a batch.
RANGE_BYTES = 32 << 20
STEP = 1 << 16


def spool(lines: IO[bytes], path: str, flush_lines: int = 256) -> int:
    """Append whole lines from a pipe to a file until the pipe ends; returns their number. A last line gets its end."""
    written = 0
    with open(path, "ab") as out:
        for line in lines:
            out.write(line if line.endswith(b"\n") else line + b"\n")
            written += 1
            if written % flush_lines == 0:
                out.flush()
    return written


def behind_last_line(path: str) -> int:
    """The byte behind the last line end of a file, 0 if there is none."""
    try:
        with open(path, "rb") as file:
            end = file.seek(0, os.SEEK_END)
            while end > 0:
                begin = max(0, end - STEP)
                file.seek(begin)
                found = file.read(end - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                end = begin
    except FileNotFoundError:  # the capture has not begun
        pass
    return 0


@dataclass
class ByteRange(InputPartition):
    first: int
    begin: int
    end: int


class LinePipeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        return {"byte": behind_last_line(self.path)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        first, stop = start["byte"], end["byte"]
        return [ByteRange(first, at, min(at + self.range_bytes, stop)) for at in range(first, stop, self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[tuple[str]]:
        with open(self.path, "rb") as file:
            file.seek(partition.begin)
            if partition.begin > partition.first:
                # A line belongs to the range that it begins in: one that began before this range is not ours.
                file.seek(partition.begin - 1)
                file.readline()
            while file.tell() < partition.end:
                yield (file.readline().rstrip(b"\r\n").decode("utf-8", "replace"),)

    def commit(self, end: dict) -> None:
        pass


class LinePipe(DataSource):
    """`spark.readStream.format("line_pipe").option("path", ...)`: one column, value."""

    @classmethod
    def name(cls) -> str:
        return "line_pipe"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> LinePipeReader:
        return LinePipeReader({k.lower(): v for k, v in self.options.items()})


def line_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of a growing file as a stream; the file lies where every executor can read it."""
    spark.dataSource.register(LinePipe)
    return spark.readStream.format("line_pipe").option("path", path).option("rangeBytes", range_bytes).load()


def piped_packets(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Decoder lines of a spooled pipe, parsed like those of `live.packet_stream`."""
    lines = line_stream(spark, path, range_bytes)
    return with_event_time(decoded_packets(lines.select(*split_decoded_line("value"))))
