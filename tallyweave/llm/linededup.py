"""Line deduplication by range-partitioned hashes (operator 8).

A line's key is the line stripped of ASCII white space with A-Z lowered; a 128-bit hash
stands for it. Hashes are range-partitioned and sorted by (hash, doc_id, position), so a run
of equal hashes starts with the document that keeps the line, and streaming a partition
finds every later document's copies. A key may fill several partitions: rows of a
partition's first run wait until the partitions' reports (one row each: first and last run)
tell whose run it goes on with. What comes back is a compressed bitmap of kept lines per
document, not text; the bitmaps then meet the documents. A row is named by doc_id and the
XXH64 of its text, so rows that share a doc_id have bitmaps of their own.

Defined results: a null or empty text is one empty line, which stays. Keys under the least
length stay. Rows that repeat a doc_id count as that one document: they lose no line to each
other, and each loses the lines that a smaller doc_id has. Null doc_ids sort last and count
as one document likewise. An empty table gives no rows. Extra columns pass `drop_lines`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, new_name, partitions, text_slices, trimmed

#: Characters that are stripped from both ends of a line.
WHITE = " \t\n\v\f\r"
LEAST = 10
#: Bytes of bitmaps, with their keys, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
#: Bytes of text that a worker holds as Python objects.
SLICE = 4 << 20


def _row(text: Column) -> Column:
    """Tells rows of equal doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line whose key has at least `least` code points; null doc_ids become LAST."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(2), SLICE):
                digests, own, pos = [], [], []
                for i, text in enumerate(part, done):
                    for n, line in enumerate(text.split("\n")):
                        key = line.strip(WHITE)
                        if len(key) >= least:
                            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                            own.append(i)
                            pos.append(n)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32())], names=["h1", "h2", "doc_id", "row", "pos"])
                done += len(part)

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), _row(F.col("text")).alias("row"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), "h1 long, h2 long, doc_id long, row long, pos int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later copies in one partition of sorted rows, and its report.

    kind 0: a later copy. kind 1: a row of the partition's first run, whose owner may stand in an
    earlier partition; `owner` is the first document seen here. kind 2, once: the first run's
    hash, and in `l1, l2, owner` the last run's hash and first document.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = key = None
    owner = 0
    names = ["kind", "part", "h1", "h2", "l1", "l2", "owner", "doc_id", "row", "pos"]

    def rows(kind: int, owners: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(doc), np.int64))
        same = lambda x: pa.array(np.full(len(doc), x, np.int64))
        return pa.RecordBatch.from_arrays([same(kind), same(part), zero, zero, zero, zero, *map(pa.array, (owners, doc, row, pos))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, pos = (c.to_numpy() for c in batch.columns)
        now = (int(h1[0]), int(h2[0]))
        new = np.concatenate([[key != now], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        owners = np.concatenate([[owner], doc[new]])[np.cumsum(new)]
        first = first or now
        opening = (h1 == first[0]) & (h2 == first[1])
        yield rows(1, owners[opening], doc[opening], row[opening], pos[opening])
        late = (doc != owners) & ~opening
        yield rows(0, owners[late], doc[late], row[late], pos[late])
        key, owner = (int(h1[-1]), int(h2[-1])), int(owners[-1])
    if first is not None:
        report = [2, part, *first, *key, owner, 0, 0]
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in report], pa.array([0], pa.int32())], names=names)


def later_copies(hashes: DataFrame, count: int | None = None) -> DataFrame:
    """(doc_id, row, pos) of every line that an earlier document has too."""
    spark = hashes.sparkSession
    importable(spark)
    order = ["h1", "h2", "doc_id", "row", "pos"]
    dealt = hashes.repartitionByRange(count or partitions(spark), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{x} long" for x in ("kind", "part", "h1", "h2", "l1", "l2", "owner", "doc_id", "row"))
    found = materialize(dealt.mapInArrow(trimmed(_stream), f"{fields}, pos int"), "line-copies")
    open_run, carry = None, []
    for r in sorted(found.filter("kind = 2").collect(), key=lambda r: r["part"]):  # a row a partition
        if open_run is not None and open_run[0] == (r["h1"], r["h2"]):
            carry.append((r["part"], open_run[1]))
        goes_on = open_run is not None and open_run[0] == (r["l1"], r["l2"])
        open_run = open_run if goes_on else ((r["l1"], r["l2"]), r["owner"])
    before = spark.createDataFrame(carry, "part long, before long")
    opening = found.filter("kind = 1").join(F.broadcast(before), "part", "left").filter("doc_id <> coalesce(before, owner)")
    return found.filter("kind = 0").select("doc_id", "row", "pos").unionByName(opening.select("doc_id", "row", "pos"))


def pack_bitmap(dropped: list[int]) -> bytes:
    """Compressed bits, 1 for a line that stays, up to the byte of the last dropped line; later lines stay."""
    bits = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack_bitmap(bitmap: bytes | None, lines: int) -> np.ndarray:
    """A flag for each of a document's lines: whether it stays."""
    keep = np.ones(lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, keep binary) for the documents that lose a line; doc_id LAST stands for null."""
    copies = later_copies(materialize(line_hashes(docs, least), "line-hashes"))
    grouped = copies.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))  # a document's lines at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pack_bitmap(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "row", "keep"])

    return materialize(grouped.mapInArrow(trimmed(run), "doc_id long, row long, keep binary"), "line-bitmaps")


def _with_bitmaps(docs: DataFrame, least: int, name: str) -> DataFrame:
    """docs with a column of that name, null for documents that lose nothing.

    The bitmaps' size is summed up first: up to BROADCAST_BYTES they are sent to the documents,
    beyond it both sides are shuffled and merged.
    """
    made = keep_bitmaps(docs, least)
    size = made.agg(F.sum(F.length("keep") + 64).alias("bytes")).first()["bytes"] or 0
    doc, row = new_name(docs, "_line_doc"), new_name(docs, "_line_row")
    bitmaps = made.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("keep").alias(name))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == bitmaps[doc]) & (_row(docs["text"]) == bitmaps[row])
    return docs.join(bitmaps.hint("broadcast" if size <= BROADCAST_BYTES else "merge"), same, "left").drop(doc, row)


def drop_lines(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """The documents with their later copies of lines dropped; other columns as they were (n_chars counts anew)."""
    importable(docs.sparkSession)
    columns, keep = docs.columns, new_name(docs, "_line_keep")

    def kept(part: list[str], maps: list[bytes | None]) -> list[str]:
        for i, bitmap in enumerate(maps):
            if bitmap is not None:
                lines = part[i].split("\n")
                part[i] = "\n".join([x for x, k in zip(lines, unpack_bitmap(bitmap, len(lines)), strict=True) if k])
        return part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            maps, done = batch.column(batch.schema.get_field_index(keep)), 0
            for part in text_slices(batch.column(at), SLICE):
                rows = batch.slice(done, len(part))
                texts = pa.array(kept(part, maps.slice(done, len(part)).to_pylist()), pa.string())
                texts = pc.if_else(rows.column(at).is_null(), None, texts).cast(batch.schema.field(at).type)
                yield rows.set_column(at, batch.schema.field(at), texts).select(columns)
                done += len(part)

    joined = _with_bitmaps(docs, least, keep)
    out = joined.mapInArrow(trimmed(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def line_digests(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE):
                total, dropped, sha = [], [], []
                for text, bitmap in zip(part, batch.column(2).slice(done, len(part)).to_pylist(), strict=True):
                    if bitmap is None:
                        total.append(text.count("\n") + 1)
                        dropped.append(0)
                        sha.append(hashlib.sha256(text.encode()).hexdigest())
                        continue
                    lines = text.split("\n")
                    kept = [x for x, k in zip(lines, unpack_bitmap(bitmap, len(lines)), strict=True) if k]
                    total.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                    sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                done += len(part)

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return _with_bitmaps(src, least, "keep").select("doc_id", "text", "keep").mapInArrow(trimmed(run), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
