"""WARC archives: index first, then coalesced byte-range reads of selected records.

Writing: each task appends its rows as individually gzip-compressed WARC/1.1
records to archives of its own, rolled at ARCHIVE_BYTES, in a folder that all
executors share, and returns one index row a record: archive, offset, length,
URL, digest, type.  The index is written as a Parquet table before anything is
read.  An archive's name holds a random part, so a task that is run again writes
anew, and only the archives that the committed index names are ever read.  No
payload is shuffled.  Where the groups of equal payloads are few, they are broadcast
to the rows by their digests.  Else every row is first written as a response to a staged
archive; the staged index, which holds no payloads, is joined with the groups, and the
staged records are read by byte ranges in the order of their offsets, responses copied as
they are and revisits written anew.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the largest id is a response, the others revisit it.  Equal rows with that id
are one response and revisits of it.

Reading: the selected index rows are dealt by archive and stretch, sorted by offset, and reads
whose gap is at most GAP_BYTES are joined, up to READ_BYTES, which bounds memory.

Edge cases: a null payload is an empty one, a null URL is recorded as none; a
null id is written and read back as null and never stands for other rows; a payload larger than the bounds is a record and a read of its own; an
empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, remove_path, skew_lookup, stored

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Bytes of records that a task reads, about, where there are many.
TASK_BYTES = 128 << 20
#: Groups of equal payloads that are broadcast at most; beyond, records are staged and the index is joined.
BROADCAST_GROUPS = 50_000
_DATE = "2020-01-01T00:00:00Z"
_INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"


def filesystem(folder: str) -> tuple[object, str]:
    """The pyarrow file system of a URI and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]
    return "\r\n".join(lines).encode()


def _one_line(url: str | None) -> str | None:
    """A URL as a header value: control characters and non-ASCII stay readable, line ends are encoded."""
    return None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{revisit}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", refers_to),
        ("Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", 0 if revisit else len(payload)),
    ]
    return _header(fields) + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one gzip member that holds one record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    return {"fields": fields, "payload": rest[:size], "whole": rest[size:] == b"\r\n\r\n"}


def payload_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html (bytes), digest."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    return rows.withColumn("digest", F.sha1("html"))


def equal_payloads(rows: DataFrame, min_revisit: int) -> DataFrame:
    """digest, keeper (largest page_id) and copies (rows with that id) of payloads that several rows share."""
    by_id = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    groups = by_id.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.max_by("c", "page_id").alias("copies"), F.sum("c").alias("n"))
    return stored(groups.where("n > 1").drop("n"), "equal-payloads")


def with_references(index: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """A staged index with refers_to: of equal payloads one record of the largest page_id, the first in the archives, is the response."""
    at = F.struct("archive", "offset")
    by_id = index.where(F.col("payload_bytes") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("c"), F.min(at).alias("first"))
    groups = by_id.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.max_by("first", "page_id").alias("first"), F.sum("c").alias("n")).where("n > 1")
    marked = skew_lookup(index, stored(groups, "staged-groups"), "digest", "n", F.xxhash64("archive", "offset"))
    return marked.select(*index.columns, F.when(at != F.col("first"), F.col("keeper")).alias("refers_to"))


class _Archives:
    """Archives that one task writes, rolled at ``most`` bytes."""

    def __init__(self, folder: str, most: int):
        self.files, self.root = filesystem(folder)
        self.files.create_dir(self.root, recursive=True)
        self.most, self.out, self.name, self.at = most, None, "", 0

    def append(self, raw: bytes) -> tuple[str, int, int]:
        """Archive, offset and length of the record that was written."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"part-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(raw)
        self.at += len(raw)
        return self.name, self.at - len(raw), len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _append(rows: DataFrame, folder: str, archive_bytes: int) -> DataFrame:
    """Write rows (page_id, url, html, digest, refers_to) as records; the index with payload_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, archive_bytes)
        for batch in batches:
            index: list[tuple] = []
            ids, urls, bodies, digests, refers = batch.columns
            for page_id, url, body, digest, to in zip(ids.to_pylist(), urls.to_pylist(), bodies, digests.to_pylist(), refers.to_pylist(), strict=True):
                payload = body.as_py()
                place = archives.append(gzip.compress(record(page_id, url, payload, digest, to), 6, mtime=0))
                index.append((*place, page_id, url, digest, "response" if to is None else "revisit", len(payload)))
            if index:
                yield _rows(index)
        archives.close()

    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, _INDEX + ", payload_bytes long")


def _settle(marked: DataFrame, staged: str, folder: str, archive_bytes: int) -> DataFrame:
    """Staged records as final ones: responses copied, the payloads of revisits left out; the index with payload_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, reader = _Archives(folder, archive_bytes), _Reader(staged)
        for batch in batches:
            rows = batch.to_pylist()
            for members, first, stop in reader.members([(r["archive"], r["offset"], r["length"]) for r in rows]):
                index = []
                for raw, r in zip(members, rows[first:stop], strict=True):
                    to = r["refers_to"]
                    if to is not None:
                        raw = gzip.compress(record(r["page_id"], r["url"], parse_record(raw)["payload"], r["digest"], to), 6, mtime=0)
                    index.append((*archives.append(raw), r["page_id"], r["url"], r["digest"], "response" if to is None else "revisit", r["payload_bytes"]))
                yield _rows(index)
        archives.close()
        reader.close()

    return _dealt(marked).mapInArrow(run, _INDEX + ", payload_bytes long")


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write every row of pages(page_id, url, html) as a record under folder; the index, stored."""
    rows = payload_rows(pages)
    groups, staged = equal_payloads(rows, min_revisit), None
    if groups.count() <= broadcast_groups and groups.where("copies > 1").isEmpty():
        own = F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
        marked = rows.join(F.broadcast(groups), "digest", "left").withColumn("refers_to", F.when(~own, F.col("keeper")))
        index = _append(marked, folder, archive_bytes)
    else:
        staged = archive_folder(pages)
        responses = stored(_append(rows.withColumn("refers_to", F.lit(None).cast("long")), staged, archive_bytes), "warc-staged-index")
        index = _settle(with_references(responses, min_revisit), staged, folder, archive_bytes)
    index = stored(index.drop("payload_bytes"), "warc-index")
    if staged:
        remove_path(pages.sparkSession, staged)
    return index


def _rows(index: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["archive", "offset", "length", "page_id", "url", "digest", "record_type", "payload_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)


def ranges(entries: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Coalesced reads of sorted (offset, length) entries: (offset, length, first entry, end entry)."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(entries):
        if out:
            start, size, first, _ = out[-1]
            if offset - (start + size) <= gap and offset + length - start <= most:
                out[-1] = (start, max(size, offset + length - start), first, i + 1)
                continue
        out.append((offset, length, i, i + 1))
    return out


class _Reader:
    """Coalesced reads of records, one open archive at a time."""

    def __init__(self, folder: str):
        self.files, self.root = filesystem(folder)
        self.current, self.source = None, None

    def members(self, places: list[tuple[str, int, int]]) -> Iterator[tuple[list[bytes], int, int]]:
        """The gzip members at places (archive, offset, length), sorted by them, with the range of places that each read covers."""
        at = 0
        while at < len(places):
            end = at
            while end < len(places) and places[end][0] == places[at][0]:
                end += 1
            if places[at][0] != self.current:
                self.close()
                self.current = places[at][0]
                self.source = self.files.open_input_file(f"{self.root}/{self.current}")
            entries = [(o, n) for _, o, n in places[at:end]]
            for offset, size, first, stop in ranges(entries):
                self.source.seek(offset)
                data = self.source.read(size)
                yield [data[o - offset : o - offset + n] for o, n in entries[first:stop]], at + first, at + stop
            at = end

    def close(self) -> None:
        if self.source is not None:
            self.source.close()


def _dealt(selected: DataFrame) -> DataFrame:
    """Index rows dealt by bytes to read, in a stated number of parts: they are so small that adaptive execution would put all into one."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = int(max(1, -(-total // TASK_BYTES), min(-(-total // READ_BYTES), int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    return selected.repartition(parts, "archive", stretch).sortWithinPartitions("archive", "offset")


def read(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows: page_id, url, record_type, refers_to, payload_bytes, digest, payload (of responses)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            for members, _, _ in reader.members(list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))):
                yield _records(members, payloads)
        reader.close()

    dealt = _dealt(selected.select("archive", "offset", "length"))
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, digest string, payload binary")


def _records(members: list[bytes], payloads: bool) -> pa.RecordBatch:
    ids, urls, kinds, refers, sizes, digests, bodies = [], [], [], [], [], [], []
    for raw in members:
        found = parse_record(raw)
        fields, body = found["fields"], found["payload"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if not found["whole"] or (kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["Payload-Length"]))):
            raise ValueError(f"record of page {fields.get('Page-Id')} is damaged")
        url = fields.get("WARC-Target-URI")
        ids.append(int(fields["Page-Id"]) if "Page-Id" in fields else None)
        urls.append(None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"))
        kinds.append(kind)
        refers.append(int(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None)
        sizes.append(int(fields["Payload-Length"]))
        digests.append(digest)
        bodies.append(body if payloads and kind == "response" else None)
    columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(kinds), pa.array(refers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"])


def resolved(records: DataFrame) -> DataFrame:
    """Records that read() gave, payloads too, with each revisit's payload taken from the response it refers to."""
    responses = records.where("record_type = 'response'").select(F.struct("page_id", "digest").alias("_of"), F.col("payload").alias("_payload"))
    revisits = records.where("record_type = 'revisit'").withColumn("_of", F.struct(F.col("refers_to").alias("page_id"), "digest"))
    uses = revisits.groupBy("_of").agg(F.count("*").alias("n"))
    # Small payloads may have several responses with an id; a revisit's has one.
    table = responses.join(uses, "_of").groupBy("_of").agg(F.max("_payload").alias("_payload"), F.max("n").alias("n"))
    found = skew_lookup(revisits, table, "_of", "n", F.xxhash64("page_id", "url")).withColumn("payload", F.col("_payload"))
    return records.where("record_type = 'response'").unionByName(found.select(*records.columns))


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives among the shared ones."""
    return fresh_path(pages.sparkSession, "warc")


def members(data: bytes) -> list[bytes]:
    """The gzip members of an archive, for readers that have no index."""
    out, stream = [], io.BytesIO(data)
    while stream.tell() < len(data):
        start, inflate = stream.tell(), zlib.decompressobj(31)
        inflate.decompress(data[start:])
        stream.seek(len(data) - len(inflate.unused_data))
        out.append(data[start : stream.tell()])
    return out
