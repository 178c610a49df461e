"""A published dump as a Spark source: ``spark.read`` or ``spark.readStream.format("dump_feed")``.

The offset of the stream is what the server says of the dump (modification date, tag and
length), so an unchanged dump makes no batch and a changed one makes one.  A plain file
is read in byte ranges, a task each; a zip archive, which cannot be entered in the middle, is spooled to the task's own disk and read as one.  A probe
that fails leaves the offset as it is: the feed is quiet then, not broken.

Options: ``url`` (http, https, file or a path), ``range_bytes`` (32 MiB), ``timeout`` (30 seconds).  Rows: line (Latin-1), source (the mark).
"""

from __future__ import annotations

import json
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import probe

RANGE_BYTES = 32 << 20
_LINES = 10_000


@dataclass
class ByteRange(InputPartition):
    """Lines that begin at start or after it and before end; end is None for an archive, read whole."""

    start: int
    end: int | None
    mark: str


class DumpFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dump_feed"

    def schema(self) -> str:
        return "line string, source string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Access:
    def __init__(self, options: dict):
        if not options.get("url"):
            raise ValueError("dump_feed needs a url")
        plain = options["url"]
        self.url = plain if ":/" in plain else f"file://{plain}"
        self.size, self.timeout = int(options.get("range_bytes", RANGE_BYTES)), float(options.get("timeout", 30))

    def mark(self) -> str | None:
        """What identifies the dump as it is now; None where it cannot be told."""
        found = probe(self.url, self.timeout)
        if found["error"] or not (found["last_modified"] or found["etag"]):
            return None
        return json.dumps([found["last_modified"], found["etag"], found.get("length")])

    def ranges(self, mark: str) -> list[ByteRange]:
        length = json.loads(mark)[2]
        if self.url.lower().endswith(".zip") or length is None:
            return [ByteRange(0, None, mark)]
        return [ByteRange(at, min(at + self.size, length), mark) for at in range(0, length, self.size)]

    def lines(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if self.mark() != part.mark:  # another dump stands there now; half of each would be neither
            raise OSError(f"{self.url} changed while it was read")
        found: list[str] = []
        for line in self._archive() if part.end is None else self._range(part.start, part.end):
            found.append(line.rstrip(b"\r\n").decode("latin-1"))
            if len(found) == _LINES:
                yield _batch(found, part.mark)
                found = []
        if found:
            yield _batch(found, part.mark)

    def _open(self, start: int):
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-"} if start else {})
        reply = urllib.request.urlopen(request, timeout=self.timeout)
        if start and getattr(reply, "status", None) != 206:  # a file, or a server without ranges
            skipped = 0
            while skipped < start and (chunk := reply.read(min(1 << 20, start - skipped))):
                skipped += len(chunk)
        return reply

    def _range(self, start: int, end: int) -> Iterator[bytes]:
        """A line belongs to the range that holds its first byte."""
        at = max(0, start - 1)
        with self._open(at) as reply:
            if start:
                at += len(reply.readline())  # the end of the line before, or just its line end
            while at < end and (line := reply.readline()):
                at += len(line)
                yield line

    def _archive(self) -> Iterator[bytes]:
        with self._open(0) as reply:
            if not self.url.lower().endswith(".zip"):
                yield from reply
                return
            with tempfile.TemporaryFile() as spool:
                while chunk := reply.read(1 << 20):
                    spool.write(chunk)
                with zipfile.ZipFile(spool) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith(".txt"))
                    for name in names[:1]:
                        with z.open(name) as text:
                            yield from text


def _batch(lines: list[str], mark: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([mark] * len(lines), pa.string())], ["line", "source"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.access = _Access(options)

    def partitions(self) -> list[ByteRange]:
        mark = self.access.mark()
        if mark is None:
            raise OSError(f"{self.access.url} cannot be probed")
        return self.access.ranges(mark)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from self.access.lines(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.access, self.last = _Access(options), ""

    def initialOffset(self) -> dict:
        return {"mark": ""}

    def latestOffset(self) -> dict:
        self.last = self.access.mark() or self.last
        return {"mark": self.last}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.last = end["mark"]
        return [] if start["mark"] == end["mark"] or not end["mark"] else self.access.ranges(end["mark"])

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from self.access.lines(partition)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(DumpFeed)
