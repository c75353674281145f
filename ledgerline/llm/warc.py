"""WARC archives of pages: a de-duplicating writer and a salvage reader.

Writer: pages of equal payload share one response record (the smallest page_id); the others become
revisit records. Only (page_id, digest) pairs are grouped, combined before the shuffle, so a payload
that a third of the pages share costs no more than others. Each record is a gzip member of its own.

Reader: Spark's binaryFile source hands whole archives (of bounded size) to tasks. Each member and
record is checked: inflation and its CRC, version line, lengths, and the block digest where it is sha1,
sha256 or md5, in hexadecimal or Base32 (another algorithm is taken on trust). After a failed check
the reader searches on for the next valid member (or, in plain archives and inside a member, version
line), goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import make_dir, write_file

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed values of the WARC 1.1 standard.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"

RECORDS = (
    "path string, start long, length long, kind string, reason string, page_id long, url string, "
    "payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def record_id(page_id: int | None, digest: str) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    block = HTTP + (b"" if refers_to is not None else payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page_id, digest),
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response",
        b"X-Payload-Length: %d" % size,
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(refers_to, digest), b"X-Refers-To-Page-Id: %d" % refers_to]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write the archives; a lazy manifest (path, records, bytes), whose evaluation writes the files.

    A null html is an empty payload. Payloads of fewer than `min_bytes` bytes are always responses, and
    so is a page without page_id; repeated rows of the smallest page_id are all responses. A null url
    leaves its header out; other columns are not read; an empty table writes no file.
    """
    make_dir(folder)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    ids = rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = ids.join(shared, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    todo = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "digest", "size", "first")
    todo = todo.sortWithinPartitions("page_id", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts: list[bytes] = []
        size = count = number = 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:04d}.warc.gz"
            written = write_file(folder, name, parts)
            return pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": written}])

        for batch in batches:
            for r in batch.to_pylist():
                parts.append(member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["size"], r["first"])))
                size, count = size + len(parts[-1]), count + 1
                if size >= roll_bytes:
                    yield flush()
                    parts, size, count, number = [], 0, 0, number + 1
        if parts:
            yield flush()

    return todo.mapInArrow(work, "path string, records long, bytes long")


def inflated(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """(content, end, True) of the gzip member at `at`; if it isn't whole and sound, what inflates, where that ends, False."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and pos < len(data):
            piece = data[pos : pos + 65536]
            out.append(unpack.decompress(piece))
            pos += len(piece)
        return b"".join(out), pos - len(unpack.unused_data), unpack.eof
    except zlib.error:
        pass
    # again from the start, in smaller pieces near the damage: a failed call gives nothing of its piece
    unpack, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while step:
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[pos : pos + step]))
            pos += step
        except zlib.error:
            unpack, step = before, step // 16
    return b"".join(out), pos, False


def number(text: str | None) -> int | None:
    """A header's 64-bit number; None for what isn't one."""
    found = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def matches(digest: str, block: bytes) -> bool:
    """Whether a labelled digest is the block's, or of an algorithm that isn't checked here."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    raw, value = hashlib.new(name, block).digest(), value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record at `at`, or None if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head: dict[str, str] = {}
    last = ""
    for line in data[at:stop].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded header goes on
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        last = name.strip().lower().decode("latin-1")
        head[last] = value.strip().decode("utf-8", "replace")
    size = number(head.get("content-length"))
    if size is None or size < 0:
        return None
    begin = stop + 4
    end = begin + size
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    if "warc-block-digest" in head and not matches(head["warc-block-digest"], block):
        return None
    return head, block, end + 4


def records_in(data: bytes) -> list[tuple[dict[str, str] | None, bytes, str]]:
    """(headers, block, reason) of inflated bytes in order; headers None marks a bad range, which the reason names."""
    rows, at, bad = [], 0, 0
    while 0 <= at < len(data):
        if one := parsed(data, at):
            if bad < at:
                rows.append((None, b"", f"damaged record, bytes {bad} to {at} of its member"))
            rows.append((one[0], one[1], ""))
            at = bad = one[2]
        else:
            at = data.find(VERSION, at + 1)
    if bad < len(data):
        rows.append((None, b"", f"damaged record, bytes {bad} to {len(data)} of its member"))
    return rows if any(head is not None for head, _, _ in rows) else []


def salvaged(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(start, length, headers, block, reason) in file order; headers None marks a quarantined gap.

    The bytes at a place say if a gzip member or a plain record is there; the search after damage is for
    what the archive was made of so far, at its start for either. Rows from inside a member, gaps too,
    have its range. Of a member that doesn't inflate to its end, sound records are read up to the damage,
    but not the record of a member of one.
    """
    view, at, made_of = memoryview(data), 0, re.escape(MAGIC) + b"|" + re.escape(VERSION)
    #: Of what is damaged: start, end of what could be read of it, that, and what it is.
    bad: tuple[int, int, list[tuple[dict[str, str] | None, bytes, str]], str] | None = None

    def closed(until: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
        if bad:
            start, stop, rows, what = bad
            stop = min(stop, until)
            for head, block, reason in rows:
                yield start, stop - start, head, block, reason
            yield stop, until - stop, None, b"", f"damaged {what}"

    while at < len(data):
        rows, whole, zipped = [], False, data[at : at + len(MAGIC)] == MAGIC
        if zipped:
            inner, end, whole = inflated(view, at)
            rows = records_in(inner)
            if rows and not whole and inner.find(VERSION, 1) < 0:
                rows = []  # one record to a member: it stands and falls with its member's check
        elif one := parsed(data, at):
            rows, end, whole = [(one[0], one[1], "")], one[2], True
        if rows:
            yield from closed(at)
            bad, made_of = None, re.escape(MAGIC if zipped else VERSION)
            if whole:
                for head, block, reason in rows:
                    yield at, end - at, head, block, reason
                at = end
                continue
            bad = at, end, rows, "member"
        elif bad is None:
            bad = at, at, [], "member" if zipped or made_of == re.escape(MAGIC) else "record"
        nxt = re.compile(made_of).search(data, at + 1)
        at = nxt.start() if nxt else len(data)
    yield from closed(len(data))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record (kind `record`) and per quarantined gap (kind `gap`) of all archives of a folder.

    Archives of other writers come too: what a record has no header for, or a header that isn't a number
    where one belongs, is null; a record without a block digest is taken as it is. An archive is read by one
    task, so it has to fit in its memory, inflated member by member.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for start, length, head, block, reason in salvaged(content.as_py()):
                    row = {"path": path, "start": start, "length": length, "kind": "record" if head else "gap", "reason": reason or None}
                    if head is not None:
                        kind = head.get("warc-type", "")
                        body = block.partition(b"\r\n\r\n")[2] if "http" in head.get("content-type", "") else block
                        whole = kind == "response"
                        row |= {
                            "page_id": number(head.get("x-page-id")), "url": head.get("warc-target-uri"), "record_type": kind,
                            "payload": body if payloads and whole else None,
                            "payload_bytes": len(body) if whole else number(head.get("x-payload-length")),
                            "payload_digest": hashlib.sha256(body).hexdigest() if whole else head.get("warc-payload-digest", "").partition(":")[2] or None,
                            "refers_to": number(head.get("x-refers-to-page-id")),
                        }
                        size += len(body)
                    rows.append(row)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(work, RECORDS)


SQL = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first from d
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first then first end as refers_to
from f
"""
