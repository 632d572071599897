"""WARC archives: a writer with identical-payload revisits, and a salvage reader.

Archives are rows of (archive, data): Spark's own commit makes a half-written one vanish with the
executor that wrote it. Every record is a gzip member of its own. The reader checks each member and
record, also within a member; where a check fails it looks for the next member or version line from which a whole record can
be read, goes on there and logs the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, stored, utf8_rows, with_row_key

ARCHIVE_BYTES, LEVEL, STEP = 4 << 20, 6, 1 << 16
DATE = "1970-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
CANDIDATE = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
#: The profile of revisits, and the digits of base 32 against those of conv().
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, in built-in functions: four times 40 bits as 8 digits each."""
    sha = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> str:
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def _unheader(value: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), value)


def record(fields: dict[str, str | None], payload: bytes, whole: int, body: bool) -> bytes:
    """One record; whole is the payload's length, body says whether the payload is in it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % whole + (payload if body else b"")
    named = fields | {"WARC-Block-Digest": f"sha1:{_b32(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {_header(v)}\r\n" for k, v in named.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record, or with a reason a quarantined gap."""

    start: int
    end: int
    reason: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    whole: int | None = None


def parse(data: bytes, at: int) -> Found | str:
    """The record at a place, or what is wrong with it."""
    if not VERSION_LINE.match(data, at):
        return "no version line"
    top = data.find(b"\r\n\r\n", at)
    if top < 0:
        return "header without end"
    fields: dict[str, str] = {}
    for line in data[at:top].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        fields[name.decode("utf-8", "replace").strip().lower()] = _unheader(value.decode("utf-8", "replace").strip())
    size = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", size):
        return "no length"
    end = top + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return "record is cut or its length is wrong"
    block = data[top + 4 : end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_b32(block)}":
        return "block digest"
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{_b32(payload)}":
        return "payload digest"
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})", head)
    return Found(at, end + 4, None, fields, payload, int(length[1]) if length else len(payload))


def member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """A gzip member's content and end, and what is wrong with it; zlib tests its checksum and length.
    Of a broken member: what could be inflated, and where that ended."""
    inflate, view, out, p = zlib.decompressobj(31), memoryview(data), [], at
    while not inflate.eof:
        if p >= len(data):
            return b"".join(out), p, "member is cut"
        before = inflate.copy()
        try:
            out.append(inflate.decompress(view[p : p + STEP]))
        except zlib.error as e:
            try:
                while True:  # byte by byte to the broken one
                    out.append(before.decompress(view[p : p + 1]))
                    p += 1
            except zlib.error:
                return b"".join(out), p, f"member: {e}"
        p += STEP
    return b"".join(out), min(p, len(data)) - len(inflate.unused_data), None


def within(content: bytes) -> Iterator[Found]:
    """The records of a member's content, and the gaps between them, by their places in the content."""
    at, gap, why = 0, -1, ""
    while at < len(content):
        one = parse(content, at)
        if isinstance(one, str):
            if gap < 0:
                gap, why = at, one
            ahead = VERSION_LINE.search(content, at + 1)
            at = ahead.start() if ahead else len(content)
            continue
        if gap >= 0:
            yield Found(gap, at, why)
            gap = -1
        yield one
        at = one.end
    if gap >= 0:
        yield Found(gap, len(content), why)


def salvage(data: bytes) -> Iterator[Found]:
    """All records that can be read whole, and the gaps between them, in order. Those of a member have
    its range; a gap in it says its place in the content. Of a broken member the records whose block
    digest holds are kept (all whole ones if it is only cut); they stand at its start, and the member
    is a gap."""
    at, gap, why, raw = 0, -1, "", 0
    while at < len(data):
        got: list[Found] = []
        bad: str | None = None
        if data.startswith(MAGIC, at):
            content, end, bad = member(data, at)
            got = list(within(content))
            if bad:
                got = [f for f in got if not f.reason and (bad == "member is cut" or "warc-block-digest" in f.fields)]
                raw = max(raw, end) if got else raw  # what was inflated isn't read again where it is stored
            elif not any(not f.reason for f in got):
                bad = got[0].reason if got else None
                got = []
            for f in got:
                f.reason = f.reason and f"{f.reason}, at {f.start} to {f.end} of the member's content"
                f.start, f.end = at, at if bad else end
        else:
            one = parse(data, at)
            if isinstance(one, str):
                bad = one
            else:
                got, end = [one], one.end
        if got:
            if gap >= 0:
                yield Found(gap, at, why)
                gap = -1
            yield from got
        if bad:
            if gap < 0:
                gap, why = at, bad
            ahead = CANDIDATE.search(data, at + 1)
            while ahead and ahead.start() < raw and not data.startswith(MAGIC, ahead.start()):
                ahead = CANDIDATE.search(data, ahead.start() + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if gap >= 0:
            yield Found(gap, at, why)
            gap = -1
        at = end
    if gap >= 0:
        yield Found(gap, len(data), why)


def decided(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least: int = 0) -> DataFrame:
    """Each row with its digest, whether it is a revisit, and of which key. Of equal payloads of least
    bytes or more the row with the largest key is the response (null is the smallest; of rows that
    repeat it, one). The payload moves once, with its row."""
    rows = with_row_key(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(payload, F.lit("")).cast("binary").alias("_body")))
    rows = rows.withColumn("_digest", digest(F.col("_body")))
    first = stored(rows.groupBy("_digest").agg(F.max(F.struct("_key", "rid")).alias("_first")), "responses")
    again = (F.length("_body") >= least) & (F.col("_first.rid") != F.col("rid"))
    return rows.join(first, "_digest").select("rid", "_key", "_url", "_body", "_digest", again.alias("_again"), F.col("_first._key").cast("string").alias("_refers"))


def write_archives(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least: int = 0, size: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, data: gzip archives of about size bytes with one record for each row, written to the
    shared folder. Null payloads are empty; null keys and addresses are left out of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, bulk = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("rid", "_key", "_url", "_digest", "_again", "_refers")]
            for rid, page, address, sha, again, refers, body in zip(*columns, utf8_rows(b.column("_body"))):
                fields = {
                    "WARC-Type": "revisit" if again else "response",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{rid}')}>",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": address,
                    "WARC-Payload-Digest": f"sha1:{sha}",
                    "WARC-Profile": PROFILE if again else None,
                    "X-Page-Id": None if page is None else str(page),
                    "X-Refers-To-Page": refers if again else None,
                }
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                one = packer.compress(record(fields, body, len(body), not again)) + packer.flush()
                held.append(one)
                bulk += len(one)
                if bulk >= size:
                    yield archive()
                    n, held, bulk = n + 1, [], 0
        if held:
            yield archive()

    return stored(mapped(decided(pages, payload, key, url, least), run, "archive string, data binary"), "archives")


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """archives: archive, data. One row for each record and gap: archive, start, end, quarantined (the
    reason, null for records), record_type, page_id, url, payload_digest, payload_bytes (of the full
    payload, also of revisits), refers_to, and the payload itself if asked for."""
    names = ["archive", "start", "end", "quarantined", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    n = 10 + payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), utf8_rows(b.column("data"))):
                rows = []
                for f in salvage(data):
                    get = f.fields.get
                    sha = get("warc-payload-digest")
                    rows.append((name, f.start, f.end, f.reason, get("warc-type"), get("x-page-id"), get("warc-target-uri"), sha and sha.partition(":")[2], f.whole, get("x-refers-to-page"), f.payload))
                for i in range(0, len(rows), 5000):
                    columns = list(zip(*rows[i : i + 5000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names[:n])

    schema = "archive string, start long, end long, quarantined string, record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * payload
    return mapped(archives.select("archive", "data"), run, schema)


def read_warc_files(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The same of .warc and .warc.gz files in any store that Spark reads; a file is a row and a task's
    work, so it may have 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), F.col("content").alias("data")), payload)


def archive_pages(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least: int = 0) -> DataFrame:
    """One row for each row of pages, as read back from the archives: key, payload_bytes,
    payload_digest, record_type, refers_to. Other columns are ignored. Null payloads are empty ones,
    repeated rows are records each (one is the response), addresses and payloads may have any length,
    and an empty table gives no rows. These archives were written a moment ago, so damage in them is an
    error."""
    kind = pages.schema[key].dataType
    found = read_archives(write_archives(pages, payload, key, url, least))
    damage = F.raise_error(F.concat_ws(" ", F.lit("damaged archive"), "archive", "quarantined"))
    found = found.where(F.when(F.col("quarantined").isNull(), True).otherwise(damage))
    return found.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
