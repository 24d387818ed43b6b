"""WARC archives: a writer and a splittable reader (operator 9).

Writing: every record is a gzip member of its own. Of records with equal payloads (by SHA-1)
of at least `least` bytes the smallest page_id is the response and the others revisit it.
Only digests that several pages share are looked up, in a table of digest and page that is
broadcast up to BROADCAST_BYTES and merged by a shuffle beyond; pages are written where they
are read in the first case, and the payload of a revisit goes to no Python worker.
Each task writes one archive to the shared folder under a name no other attempt has, and
reports it; only reports of tasks that succeeded are used, so a lost executor leaves an
unread file at most.

Reading: tasks get byte ranges of archives, about TASK bytes each and dealt one by one. A
task scans its range for the gzip magic; a
candidate counts when the member it starts really decodes to a WARC header. A record belongs
to the range that its first byte lies in and is read past the range's end. A magic number
inside compressed data fails to decode, and what a decoded member covers is not scanned.

Defined results: a null html is an empty payload. Rows that repeat a page_id count as the
same page: all are written, with one type. A null page_id is written as such and revisits
like any other; where all equal payloads have none, they are responses. An empty table gives
no rows. Urls are written percent-encoded where they hold control characters or spaces.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, partitions, scratch_path, trimmed

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, the unit that tasks share out.
RANGE = 4 << 20
#: Bytes of ranges that a task reads, about, where there are more ranges than partitions.
TASK = 64 << 20
#: Bytes of shared digests, with their pages, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a shared digest's row in that reckoning.
SHARED_ROW = 128
#: Payload bytes and rows that a worker holds as Python objects.
HELD_BYTES, HELD_ROWS = 4 << 20, 256
_CHUNK = 1 << 16
_DATE = "2000-01-01T00:00:00Z"


def payload_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest hex, page: the response's page_id, revisit): payload is null for revisits."""
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    shared = src.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("page"), F.count("*").alias("n")).filter("n > 1").select("digest", "page")
    shared = materialize(shared, "warc-shared")
    small = shared.count() * SHARED_ROW <= BROADCAST_BYTES
    joined = src.join(shared.hint("broadcast" if small else "merge"), "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("page")) & F.col("page").isNotNull(), F.lit(False))
    return joined.withColumn("revisit", revisit).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload, of `size` bytes, and names the page it repeats."""
    name = "null" if page_id is None else str(page_id)
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", quote(url or "", safe="".join(map(chr, range(33, 127))))),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{b32}"),
        ("X-Payload-Bytes", str(size)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of HELD_ROWS rows and HELD_BYTES payload bytes, about; a larger payload is a run of its own."""
    for batch in batches:
        size = pc.binary_length(batch.column(2)).fill_null(0).to_numpy().astype("int64").cumsum()
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, min(at + HELD_ROWS, int(size.searchsorted(before + HELD_BYTES, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def write_archives(typed: DataFrame, path: str) -> DataFrame:
    """(file, bytes): the archives written under `path`, one a task."""
    importable(typed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, total, where = None, 0, None
        for part in _pieces(batches):
            for page_id, url, payload, size, digest, page, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    system, folder = fs.FileSystem.from_uri(path)
                    system.create_dir(folder, recursive=True)
                    where = f"/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(folder + where, compression=None)
                raw = record(page_id, url, payload, size, digest, page if revisit else None)
                out.write(raw)
                total += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path + where]), pa.array([total], pa.int64())], names=["file", "bytes"])

    return typed.select("page_id", "url", "payload", "size", "digest", "page", "revisit").mapInArrow(trimmed(run), "file string, bytes long")


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of an uncompressed record; None if it isn't one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        return None
    fields = dict(x.split(": ", 1) for x in raw[:end].decode().split("\r\n")[1:] if ": " in x)
    try:
        size = int(fields["Content-Length"])
    except (KeyError, ValueError):
        return None
    return (fields, raw[end + 4 : end + 4 + size]) if len(raw) >= end + 4 + size else None


def records_from(handle, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records whose first byte lies in start..end of an open archive."""
    handle.seek(start)
    window, base = handle.read(min(end + len(MAGIC) - 1, size) - start), start
    at = window.find(MAGIC)
    while at >= 0 and base + at < end:
        unpack, parts, fed = zlib.decompressobj(31), [], at
        offset, ok = base + at, True
        extra = b""
        try:
            while not unpack.eof:
                if fed < len(window):
                    data = window[fed : fed + _CHUNK]
                    fed += len(data)
                else:
                    handle.seek(base + len(window) + len(extra))
                    data = handle.read(_CHUNK)
                    extra += data
                    if not data:
                        ok = False
                        break
                parts.append(unpack.decompress(data))
                if len(parts) == 1 and not parts[0].startswith(b"WARC/"[: len(parts[0])]):
                    ok = False
                    break
        except zlib.error:
            ok = False
        found = parse(b"".join(parts)) if ok else None
        if found is None:
            at = window.find(MAGIC, at + 1)
            continue
        yield offset, *found
        used = fed - at + len(extra) - len(unpack.unused_data)
        at = window.find(MAGIC, at + used) if at + used < len(window) else -1


def _ranges(files: DataFrame, span: int) -> DataFrame:
    """(file, bytes, start): a row for each range of `span` bytes, dealt one by one to a number of partitions that follows the bytes.

    The number is given, so that adaptive plans don't take these short rows for a small table.
    """
    sums = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.greatest(F.ceil(F.col("bytes") / span), F.lit(1))), F.lit(0)).alias("ranges")).first()
    tasks = min(int(sums["ranges"]), max(partitions(files.sparkSession), -(-int(sums["bytes"]) // max(TASK, span))))
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(span).cast("long"))).alias("start"))
    return ranges.repartition(max(1, tasks))


def read_archives(files: DataFrame, *, span: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records of (file, bytes) archives, read in byte ranges of `span`.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): payload is null for
    revisits. Without `payloads` that column is left out; payloads are read and held against their digests all the same.
    """
    importable(files.sparkSession)
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=names)

        for batch in batches:
            for file, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                system, where = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_file(where) as handle:
                    for _, found, block in records_from(handle, start, min(start + span, size), size):
                        rows.append(_row(found, block)[: 6 + payloads])
                        held += len(block) * payloads
                        if held >= HELD_BYTES or len(rows) >= 16 * HELD_ROWS:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return _ranges(files, span).mapInArrow(trimmed(run), fields)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    to = fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if to is None:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of page {page} doesn't match its digest")
    return (
        None if page == "null" else int(page), fields["WARC-Target-URI"], int(fields["X-Payload-Bytes"]), digest, fields["WARC-Type"],
        None if to is None else int(to.removeprefix("<urn:page:").removesuffix(">")), payload,
    )


def archive_pages(pages: DataFrame, *, least: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages to archives under `path` (the shared folder by default); (file, bytes) of what was written."""
    spark: SparkSession = pages.sparkSession
    return materialize(write_archives(payload_types(pages, least), path or scratch_path(spark, "warc")), "warc-files")
