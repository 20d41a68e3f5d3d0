"""WARC archives, and archives without repeated payloads.

``write_warc`` turns page rows into archives: files of gzip members, one record
a member, every page a ``response`` record with its HTTP head.  The rows it
returns, one a record, are the records' headers: file, offset, length, page,
record id, payload digest and size.

``resolved`` deals these headers, not the payloads, by payload digest and finds
each digest's original, the record of the largest page id.  The others learn
the original's page and record id.  ``rewritten`` deals the headers by file; a
task reads its file from start to end, gives responses fresh headers around
their blocks, and writes the repeats as ``revisit`` records (HTTP head only).

Files are known by manifests that Spark writes; their names are unique by
attempt, so files of failed attempts are never read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import saved, shared_folder, table

#: bytes of an archive after which the next one is begun, and bytes read at once
ROLL, READ = 64_000_000, 131_072
LEVEL = 3
#: digests with more records than this are joined by broadcast; there are at most 100,000 of them
HOT, HOT_DIGESTS = 10_000, 100_000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: fields of our own: the page of a record and of the record it refers to
PAGE, REFERS_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"
_BREAKS = re.compile("[\x00-\x20\x7f]")

_HEADERS = "file string, at long, length long, page_id long, url string, record_id string, payload_digest string, check binary, payload_bytes long"
_HEADER_SCHEMA = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_id", pa.string()), ("payload_digest", pa.string()), ("check", pa.binary()), ("payload_bytes", pa.int64()),
])


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    """A value that keeps to its line: controls and spaces are percent-encoded."""
    return _BREAKS.sub(lambda m: f"%{ord(m.group()):02X}", value)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([pack.compress("\r\n".join(lines).encode()), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()])


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record ends early")
    return fields, rest[:size]


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def http_parts(block: bytes) -> tuple[bytes, bytes, int]:
    """HTTP head, payload and the payload's size as the head states it."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
    return head + gap, payload, int(size.group(1)) if size else len(payload)


def _open(folder: str, name: str, write: bool = False):
    store, path = pafs.FileSystem.from_uri(folder)
    if write:
        store.create_dir(path, recursive=True)
        return store.open_output_stream(f"{path}/{name}", compression=None)
    return store.open_input_stream(f"{path}/{name}", compression=None)


class _Archive:
    """Writes records to files of about ``ROLL`` bytes."""

    def __init__(self, folder: str, part: int, date: str):
        self.folder, self.part, self.date = folder, part, date
        self.stream, self.name, self.at = None, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """File, offset and length of the record."""
        if self.stream is not None and self.at >= ROLL:
            self.close()
        if self.stream is None:
            self.name, self.at = f"part-{self.part:06d}-{uuid.uuid4().hex}.warc.gz", 0
            self.stream = _open(self.folder, self.name, True)
            self._write(record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
            ], b"format: WARC File Format 1.1\r\n"))
        found = (self.name, self.at, len(data))
        self._write(data)
        return found

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def response(page_id, url: str | None, record_id: str, date: str, digest: str, block: bytes) -> bytes:
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), (PAGE, page_id if page_id is None else str(page_id)),
    ], block)


def revisit(page_id, url: str | None, record_id: str, date: str, digest: str, head: bytes, to: dict) -> bytes:
    return record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", f"<urn:uuid:{to['record_id']}>"), ("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", to["date"]),
        ("Content-Type", "application/http; msgtype=response"), (PAGE, page_id if page_id is None else str(page_id)),
        (REFERS_PAGE, to["page_id"] if to["page_id"] is None else str(to["page_id"])),
    ], head)


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_warc(df: DataFrame, folder: str, html: str = "html", url: str = "url", id_: str = "page_id", date: str | None = None) -> DataFrame:
    """Write every row as a response record to archives in ``folder`` and return the records' headers.

    ``folder`` is a path or URI that all executors share.  Null html is an empty
    payload; a null id or url gives a record without that field.  Rows are
    written where they are read; nothing is shuffled.  Only the three columns
    are used.  An empty table gives no archive.
    """
    date = date or now()
    given = df.select(F.col(id_).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        archive = _Archive(folder, TaskContext.get().partitionId(), date)
        for batch in batches:
            rows = []
            for page_id, uri, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                payload = value.as_py() or b""
                uri = uri if uri is None else header_text(uri)
                known, digest = str(uuid.uuid4()), payload_digest(payload)
                place = archive.add(response(page_id, uri, known, date, digest, http_head(len(payload)) + payload))
                rows.append((*place, page_id, uri, known, digest, xxhash.xxh3_128_digest(payload), len(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HEADER_SCHEMA)], schema=_HEADER_SCHEMA)
        archive.close()

    return saved(given.mapInArrow(run, _HEADERS))


def fresh_id(record_id: str) -> str:
    """The id of a record in the rewritten archive: the same for every task that names it."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, record_id))


def resolved(headers: DataFrame, least: int = 0) -> DataFrame:
    """The headers with ``original``: null for responses, else (page_id, record_id, url) of the response they repeat.

    Payloads are equal if digest, a second 128-bit hash and size are.  The
    original has the largest page id (null smallest; ties: the largest record
    id).  Payloads of fewer than ``least`` bytes are never revisits.
    """
    keys = ["payload_digest", "check", "payload_bytes"]
    best = F.struct("page_id", "record_id", "url")
    large = headers.where(F.col("payload_bytes") >= least)
    groups = saved(large.groupBy(*keys).agg(F.max(best).alias("original"), F.count(F.lit(1)).alias("records")).where("records > 1"))
    limit = max(HOT, headers.count() // HOT_DIGESTS)
    hot = F.broadcast(groups.where(F.col("records") > limit).drop("records"))
    rest = groups.where(F.col("records") <= limit).drop("records")
    one = headers.join(hot, keys)
    two = headers.join(hot, keys, "left_anti").join(rest, keys, "left")
    found = one.unionByName(two)
    return found.withColumn("original", F.when(F.col("original.record_id") != F.col("record_id"), F.col("original")))


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(READ)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or stream.read(READ)
    if parts:
        raise ValueError("the archive ends early")


_RESOLVED = "file string, records long"


def rewritten(headers: DataFrame, source: str, folder: str, date: str | None = None) -> DataFrame:
    """Write the records of ``source`` to ``folder`` as their resolved headers say; returns the manifest (file, records).

    Records without a header are left out.  Every other record keeps its place in the order of its file and gets a fresh id
    and date; a response's block is copied, a revisit has its HTTP head only.
    """
    date = date or now()
    known = saved(headers.select("file", "at", "record_id", "original"))
    count = known.select("file").distinct().count()
    dealt = known.repartitionByRange(max(1, count), "file").sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, counts = _Archive(folder, TaskContext.get().partitionId(), date), {}
        name = stream = reader = None
        for batch in batches:
            for file, wanted, original in zip(*(batch.column(c).to_pylist() for c in ("file", "record_id", "original"))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, _open(source, file)
                    reader = map(parsed, members(stream))
                fields, block = next(r for r in reader if r[0]["warc-record-id"] == f"<urn:uuid:{wanted}>")
                known = fresh_id(wanted)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                page, uri = fields.get(PAGE.lower()), fields.get("warc-target-uri")
                if original is None:
                    data = response(page, uri, known, date, digest, block)
                else:
                    to = {**original, "record_id": fresh_id(original["record_id"]), "date": date}
                    data = revisit(page, uri, known, date, digest, http_parts(block)[0], to)
                file_now = archive.add(data)[0]
                counts[file_now] = counts.get(file_now, 0) + 1
        if stream is not None:
            stream.close()
        archive.close()
        if counts:
            yield pa.RecordBatch.from_pydict({"file": list(counts), "records": pa.array(counts.values(), pa.int64())})

    return saved(dealt.mapInArrow(run, _RESOLVED))


_RECORDS = ("file string, record_type string, record_id string, refers_to_id string, url string, page_id long, refers_to long, "
            "payload_digest string, payload_bytes long")
_RECORD_SCHEMA = pa.schema([
    ("file", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("url", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_warc(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record but the archives' own: type, ids, url, page, digest and size of the full payload.

    A response's digest is worked out anew and must equal its header's.  A
    revisit's size is the one its HTTP head states.  With ``payloads`` the rows
    have a last column ``payload`` (null for revisits).
    """
    schema = _RECORD_SCHEMA.append(pa.field("payload", pa.binary())) if payloads else _RECORD_SCHEMA
    names = manifest.select("file").distinct()
    count = names.count()

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _open(folder, file) as stream:
                    for data in members(stream):
                        fields, block = parsed(data)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        _, payload, size = http_parts(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
                            raise ValueError(f"{file}: a payload differs from its header")
                        rows.append((
                            file, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri"),
                            _number(fields.get(PAGE.lower())), _number(fields.get(REFERS_PAGE.lower())), digest, size,
                            *([payload if kind == "response" else None] if payloads else []),
                        ))
                        held += 200 + len(payload) * payloads
                        if held >= 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return names.repartition(max(1, count), "file").mapInArrow(run, _RECORDS + (", payload binary" if payloads else ""))


def deduplicated(headers: DataFrame, source: str, folder: str, least: int = 0) -> DataFrame:
    """Archives of ``source`` (``write_warc``) written to ``folder`` with repeats as revisits; returns the manifest."""
    return rewritten(resolved(headers, least), source, folder)


def op12_warc(spark, folder: str) -> DataFrame:
    """Every page's record in the archives without repeats: payload size and digest, type and the page it refers to."""
    root = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    raw, final = f"{root}/raw", f"{root}/final"
    manifest = deduplicated(write_warc(table(spark, folder, "pages"), raw), raw, final)
    return read_warc(manifest, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS size, sha1(h) AS hex, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS turn,
  max(page_id) OVER (PARTITION BY h) AS best FROM p),
parts AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS fives FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN turn > 1 THEN best END AS refers_to
FROM parts
"""
