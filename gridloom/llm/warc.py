"""WARC archives: a writer that runs through Spark, and a salvage reader.

The reader checks each record (version line, header, length, end mark, block
digest). After a failed check it searches for the next valid gzip member or version
line, goes on there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.frames import attach, as_bytes, pieces
from gridloom.session import new_path, ship, store

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_VERSION_ROW = re.compile(rb"(?m)^WARC/1\.[01]\r?$")
#: What is percent-encoded in a written URI: white space and controls.
_ODD = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ONCE = {"warc-type", "warc-record-id", "content-length"}
_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing. The text sink puts it between rows, which keeps the file a sequence of members.
_NOTHING = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Compressed bytes of a row of the sink, and rows of a file: archives of about 32 MB.
BLOCK_BYTES, BLOCKS_IN_FILE = 1 << 20, 32
#: Groups of equal payloads (under 100 bytes each) up to which they are broadcast.
BROADCAST_GROUPS = 500_000
#: Bytes in which a header's end is looked for at once; that of a longer one before the next version line.
HEADER_LIMIT = 1 << 16
PREFIX = "urn:x-record:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, block: bytes, headers: dict[str, str]) -> bytes:
    """A WARC record; Content-Length and WARC-Block-Digest are added."""
    lines = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + _END


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record, or (kind "gap") bytes that no valid record covers."""

    kind: str
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""


def _parse(data: bytes, at: int) -> Found | tuple[str, int]:
    """The record at ``at``, or why there is none and where to go on (-1: search)."""
    if not (line := _VERSION_LINE.match(data, at)):
        return "no version line", -1
    cut = data.find(_END, line.end() - 2, line.end() + HEADER_LIMIT)
    if cut < 0:
        later = _VERSION_ROW.search(data, line.end())
        cut = data.find(_END, line.end() - 2, later.start() if later else len(data))
    if cut < 0:
        return "header without end", -1
    head = data[line.end() : cut]
    if _VERSION_ROW.search(head) or _CONTROL.search(head):
        return "damaged header", -1
    headers = {}
    for row in head.split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon and row.strip():
            return "damaged header", -1
        if colon:
            key = name.strip().decode("utf-8", "replace").lower()
            if key in headers and key in _ONCE:  # two headers run together
                return "damaged header", -1
            headers[key] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or not {"warc-type", "warc-record-id"} <= headers.keys():
        return "damaged header", -1
    start = cut + 4
    end = start + int(length)
    if end > len(data):
        return "cut off", -1
    if data[end : end + 4] != _END and not (end + 4 > len(data) and _END.startswith(data[end:])):
        return "no end mark", -1
    block, after = data[start:end], min(end + 4, len(data))
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        return "block digest differs", after
    return Found(headers["warc-type"], at, after, headers, block)


def _plain(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        got = _parse(data, at)
        if isinstance(got, Found):
            yield got
            at = got.end
            continue
        why, after = got
        if after < 0:
            later = _VERSION_LINE.search(data, at + 1)
            while later and data[later.start() - 1 : later.start()] != b"\n" and not isinstance(_parse(data, later.start()), Found):
                later = _VERSION_LINE.search(data, later.start() + 1)
            after = later.start() if later else len(data)
        yield Found("gap", at, after, reason=why)
        at = after


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and its end; None if damaged."""
    unpacker, view, out, place = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not unpacker.eof and place < len(data):
            part = view[place : place + 65_536]
            out.append(unpacker.decompress(part))
            place += len(part)
    except zlib.error:
        return None
    return (b"".join(out), place - len(unpacker.unused_data)) if unpacker.eof else None


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, plain or gzip with a member for each record.

    Places are bytes of the file; for a record in a gzip member, the member's. Gaps
    and records cover the file without overlap. Empty members are part of neither.
    """
    if not data:
        return
    if not data.startswith(_MAGIC) and (_VERSION_LINE.search(data) or data.find(_MAGIC) < 0):
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        if data.startswith(_MAGIC, at) and (got := _member(data, at)):
            content, end = got
            for x in _plain(content):
                yield Found(x.kind, at, end, x.headers, x.block, x.reason)
            at = end
            continue
        why = "damaged member" if data.startswith(_MAGIC, at) else "no member"
        after = data.find(_MAGIC, at + 1)
        while after >= 0 and _member(data, after) is None:
            after = data.find(_MAGIC, after + 1)
        after = after if after >= 0 else len(data)
        yield Found("gap", at, after, reason=why)
        at = after


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _writer(date: str, compressed: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, uri, payload, refers_to) -> blocks of records."""
        held: list[bytes] = []
        size = 0
        for batch in pieces(batches, 256):
            for key, uri, payload, refers in zip(
                batch["id"].to_pylist(),
                batch["uri"].to_pylist(),
                as_bytes(batch["payload"]),
                batch["refers_to"].to_pylist(),
                strict=True,
            ):
                payload = payload or b""
                headers = {
                    "WARC-Record-ID": f"<{PREFIX}{'null' if key is None else key}>",
                    "WARC-Date": date,
                    **({"WARC-Target-URI": _ODD.sub(lambda m: quote(m[0]), uri)} if uri else {}),
                    "Content-Type": "application/http; msgtype=response",
                    "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                }
                if refers is None:
                    data = record("response", _http(len(payload)) + payload, headers)
                else:
                    headers |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": f"<{PREFIX}{refers}>",
                    }
                    data = record("revisit", _http(len(payload)), headers)
                # The plain sink's line end is the second half of a record's end mark.
                data = member(data) if compressed else data
                held.append(data)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b"".join(held) if compressed else b"".join(held)[:-2]], pa.binary())],
                        ["value"],
                    )
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held) if compressed else b"".join(held)[:-2]], pa.binary())], ["value"])

    return write


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2026-01-01T00:00:00Z",
    compressed: bool = True,
) -> None:
    """Write one record per row to archives under ``path``.

    Payload: the column's UTF-8 bytes (null: empty). Of records with equal payloads of
    at least ``min_revisit_bytes`` bytes the one with the largest id is a response and
    the others are revisits of it; rows that share the largest id are all responses,
    as are rows whose group has no id at all; a null id is smaller than any other.
    Spark's text sink carries the bytes: it commits by task, so a lost executor leaves
    no half archive, and it writes to every store that Spark does.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("bytes", F.length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and top is not null")
    # Where the groups are few, the payloads stay where they are.
    rows = attach(rows, groups, ["sha", "bytes"], [F.col("id"), F.col("uri")], "left", "n", BROADCAST_GROUPS)
    refers = F.when(~F.col("top").eqNullSafe(F.col("id")), F.col("top"))
    blocks = rows.select("id", "uri", "payload", refers.alias("refers_to")).mapInArrow(_writer(date, compressed), "value binary")
    sink = blocks.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", BLOCKS_IN_FILE)
    if compressed:
        sink.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).text(path)
    else:
        sink.option("lineSep", "\r\n").text(path)


FIELDS = "archive string, start long, end long, kind string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, reason string"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                archive, data = batch["path"][i].as_py(), batch["content"][i].as_py()
                rows: list[tuple] = []
                held = 0
                for x in salvage(data):
                    h = x.headers
                    head, cut, payload = x.block.partition(_END) if x.block.startswith(b"HTTP/") else (b"", b"", x.block)
                    length, told = len(payload), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if x.kind == "revisit":
                        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                        length = int(size[1]) if size else None
                    elif x.kind != "gap":
                        own = digest(payload)
                        if told and own != told:
                            x.kind, x.reason = "gap", "payload digest differs"
                        told = own
                    strip = lambda name: h[name].strip("<>").removeprefix(PREFIX) if name in h else None
                    rows.append((
                        archive,
                        x.start,
                        x.end,
                        x.kind,
                        strip("warc-record-id"),
                        h.get("warc-target-uri"),
                        strip("warc-refers-to"),
                        payload if with_payload and x.kind != "gap" else None,
                        length if x.kind != "gap" else None,
                        told or None,
                        x.reason or None,
                    ))
                    held += len(payload) if with_payload else 200
                    if held > 1 << 22:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under ``path``.

    ``kind`` is the record's type, or ``gap`` for bytes from ``start`` to ``end`` that
    failed for ``reason``. A file is one row for Spark, so archives go up to 2 GB;
    a task holds one file at a time. Empty files and an empty folder give no rows; headers that a
    record lacks are null; records that repeat an id come one by one, however long their payloads.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(_reader(with_payload), FIELDS)


def records(found: DataFrame) -> DataFrame:
    return found.where("kind <> 'gap'")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: archive, start, end, reason."""
    return found.where("kind = 'gap'").select("archive", "start", "end", "reason")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages -> archives in the shared folder -> a row per page, from the archives.

    Null html is an empty payload, a null url leaves the header out, and a null id is smaller than any other
    and comes back null. Rows that repeat an id come back each; of equal payloads those with the largest id
    are responses. Payloads and urls may be of any length. Other columns are not read, whatever their names. An empty table gives
    no rows. RuntimeError if the archives don't give back as many records as there are pages.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    found = store(read_archives(spark, path, with_payload=False).drop("payload"), "records")
    written, read = pages.count(), records(found).count()
    if read != written:
        raise RuntimeError(f"{written} pages written, {read} records read; {gaps(found).take(3)}")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return records(found).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to")
    )
