"""WARC archives: records as single gzip members, repeated payloads as revisits, and a splittable reader.

Writing.  Of records with equal payloads of some size, the one with the largest id is a response and the others refer to
it; a task writes its records into one archive, a gzip member each.

Reading.  Tasks take byte ranges.  A task looks for the gzip magic in its range, and takes a candidate for a member only
if it inflates to a WARC header; a record belongs to the range that its member starts in, and the task reads on past its
range's end to finish it.  From a member's end the next one is known, so only the first of a range has to be searched.

Defined results: a null payload is an empty one; a null id is never the largest where there is another; rows with the
largest id of their payload are all responses; control characters in addresses are percent-encoded; an empty table
gives no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import file_system, put, shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
LEAST_BYTES = 1000
SPLIT_BYTES = 8 << 20
ARCHIVE_BYTES = 64 << 20
SALTS = 16
_READ = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(id: int | None) -> str:
    return f"<urn:page:{'' if id is None else id}>"


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _address(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "")


def record(id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member.  A revisit holds the HTTP head only, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(id)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_address(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Head and block of an inflated record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields.get("content-length", 0))]


def members(read_at, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offsets and contents of the members that start in [start, stop); `read_at(offset, n)` gives bytes of the file."""
    at, sure = start, start == 0
    buffer, base = b"", start
    while at < stop:
        if not sure:
            # Search on: a candidate may begin in this range's last bytes and end behind it.
            if not base <= at < base + len(buffer) - 2:
                buffer, base = read_at(at, min(_READ, stop + 2 - at)), at
            found = buffer.find(MAGIC, at - base)
            if found < 0:
                following = base + len(buffer) - 2
                if following <= at or base + len(buffer) >= min(stop + 2, size):
                    return
                at, buffer = following, b""
                continue
            at = base + found
            if at >= stop:
                return
        content = _inflate(read_at, size, at)
        if content is None:
            at, sure = at + 1, False
        else:
            yield at, content[0]
            at, sure = content[1], True


def _inflate(read_at, size: int, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at an offset, or None if what is there is no member with a WARC header."""
    inflater, out, position, checked = zlib.decompressobj(31), [], at, 0
    while not inflater.eof:
        chunk = read_at(position, min(_READ if position > at else 1 << 14, size - position))
        if not chunk:
            return None
        try:
            out.append(inflater.decompress(chunk))
        except zlib.error:
            return None
        position += len(chunk)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = 1
    content = b"".join(out)
    return (content, position - len(inflater.unused_data)) if content.startswith(b"WARC/") else None


def with_originals(
    pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Rows (`page_id`, `url`, `payload`, `digest`, `revisit`, `refers_to`).

    The originals of repeated payloads are found by one aggregate (combined before the shuffle).  The join back is
    salted by row, with a copy of each original per salt, so a payload that a third of all pages share is spread.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    originals = (
        rows.where(large).groupBy("digest").agg(F.max("page_id").alias("_original"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("digest", "_original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salt = F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))  # small ones meet nothing
    revisit = F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original"))
    return rows.withColumn("_salt", salt).join(originals, ["digest", "_salt"], "left").select(
        "page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("_original")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes what `with_originals` gives; returns (`path`, `bytes`, `records`) of the archives that count."""
    folder = folder or shared_folder(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, out, size = 0, [], 0

        def flush():
            path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
            put(path, b"".join(out))
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [len(out)]})

        for batch in batches:
            for values in zip(*(batch.column(k) for k in range(6))):
                id, url, payload, digest, revisit, refers_to = (v.as_py() for v in values)
                out.append(record(id, url, payload, digest, refers_to, revisit))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield flush()
                    number, out, size = number + 1, [], 0
        if out:
            yield flush()

    columns = rows.select("page_id", "url", "payload", "digest", "revisit", "refers_to")
    return stored(columns.mapInArrow(write, "path string, bytes long, records long"), "warc-archives")


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows (`page_id`, `url`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, `payload`) of all records.

    `payload` is null for a revisit; the digest of a response is that of the payload read, and must be the header's.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                size = fs.get_file_info(name).size
                at = np.arange(0, size, split_bytes)
                columns = [pa.array([path] * len(at)), pa.array(at), pa.array(np.minimum(at + split_bytes, size))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "from", "to"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for split in batch.to_pylist():
                fs, name = file_system(split["path"])
                rows, size = [], 0
                with fs.open_input_file(name) as file:
                    for _, content in members(lambda at, n: file.read_at(n, at), file.size(), split["from"], split["to"]):
                        rows.append(_row(*parse(content)))
                        size += len(content)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)
    splits = archives.select("path").mapInArrow(cut, "path string, from long, to long").repartition(spread)
    return splits.mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def _row(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        payload = None
    else:
        length = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload does not have the digest of its header")
    return (
        _id(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, kind,
        _id(fields.get("warc-refers-to")), payload,
    )
