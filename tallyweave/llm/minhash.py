"""MinHash document fingerprints (operator 4).

Words (runs of anything but ASCII white space) are hashed in numpy over the bytes of many
texts at once, runs of five words make shingles, and every one of PERMUTATIONS universal
hashes (multiply and add, modulo 2**64, upper bits) keeps its minimum over a text's shingles.
A fingerprint is the upper 16 bits of each minimum, in base64. The share of equal components
estimates the Jaccard likeness of two texts' shingle sets.

`bands` joins band keys of the signatures in Spark and verifies the Jaccard likeness of what
meets on the shingle sets themselves.

Defined results: null texts count as empty. Texts of fewer words than a shingle have one
shingle, the whole; texts without words have none, and a fingerprint of their own that is
like only itself. Rows that repeat a doc_id are ordered by text. Null doc_ids come last in
descending order. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, partitions, trimmed

WIDTH = 5
PERMUTATIONS = 128
BANDS = 32
_LOW = -(1 << 63)
_BLOCK = 1 << 15  # shingles that are permuted at once; they stay in the processor's cache
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, one text after the other, and each text's number of them."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lens)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~white
    begins = np.flatnonzero(word & np.concatenate([[True], white[:-1]]))
    counts = np.diff(np.concatenate([[0], np.searchsorted(begins, ends)]))
    if not len(begins):
        return np.zeros(0, np.uint64), counts
    inside = np.flatnonzero(word)
    sizes = np.flatnonzero(word & np.concatenate([white[1:], [True]])) - begins + 1
    first = np.cumsum(sizes) - sizes
    rel = np.arange(len(inside)) - np.repeat(first, sizes)
    hashes = _mix(np.add.reduceat(_POWERS.take(rel, mode="wrap") * (raw[inside].astype(np.uint64) + (rel >> 12).astype(np.uint64) * np.uint64(257) + np.uint64(1)), first) + sizes.astype(np.uint64))
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(np.cumsum(counts) - counts, made)
    own = np.repeat(np.minimum(counts, width), made)  # words in the shingle
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = own.astype(np.uint64)
    for j in range(width):
        total = total + np.where(j < own, padded[at + j] * _C[j], np.uint64(0))
    return _mix(total), made


def signatures(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Texts x PERMUTATIONS array of 32-bit minima; all ones where a text has no shingle."""
    hashes, made = shingles(texts, width)
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(made)
    ends = np.cumsum(made[full])
    a = 0
    while a < len(full):
        low = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, low + _BLOCK)))
        block, cuts = hashes[low : ends[b - 1]], ends[a:b] - made[full[a:b]] - low
        for k in range(PERMUTATIONS):
            out[full[a:b], k] = np.minimum.reduceat(block * _A[k] + _B[k], cuts) >> np.uint64(32)
        a = b
    return out


def fingerprint(signature: np.ndarray) -> str:
    return base64.b64encode((signature >> np.uint32(16)).astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal fingerprint components, row by row."""
    return ((a >> np.uint32(16)) == (b >> np.uint32(16))).mean(axis=1)


def band_keys(made: np.ndarray) -> np.ndarray:
    """Texts x BANDS array of longs from texts' signatures, a key for each run of components."""
    whole = made.reshape(len(made), BANDS, -1).astype(np.uint64) * _C[: PERMUTATIONS // BANDS]
    return _mix(np.add.reduce(whole, axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, halo, key, doc_id, text): runs of doc_ids, each followed (halo 1) by the row that comes next.

    Buckets are ranges of doc_id of about equal row counts, cut at quantiles of doc_id.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)))
    wanted = 10 * partitions(spark)
    ids = src.filter("doc_id is not null").select(F.col("doc_id").cast("double").alias("x"))
    cuts = ids.approxQuantile("x", [k / wanted for k in range(1, wanted)], 0.25 / wanted)
    from pyspark.ml.feature import Bucketizer

    find = Bucketizer(splits=[-float("inf"), *sorted(set(cuts or [0.0])), float("inf")], inputCol="x", outputCol="b")
    own = find.transform(src.withColumn("x", F.col("key").cast("double"))).select(F.col("b").cast("int").alias("bucket"), F.lit(0).alias("halo"), "key", "doc_id", "text")
    most = {r["bucket"]: r["most"] for r in own.groupBy("bucket").agg(F.max("key").alias("most")).collect()}  # a row a bucket
    used = sorted(most)
    follows = [(most[a], b) for a, b in zip([used[-1], *used], used, strict=False)] if used else []  # bucket b ends with what has the largest id below it
    small = F.broadcast(spark.createDataFrame(follows, "key long, bucket int"))
    return own.unionByName(src.join(small, "key").select("bucket", F.lit(1).alias("halo"), "key", "doc_id", "text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next text in descending doc_id.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    spark = docs.sparkSession
    importable(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        """For all rows but the last: rows are (bucket, halo, doc_id, text) in order."""
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        need = sorted({*pairs, *(i + 1 for i in pairs)})
        where = {i: n for n, i in enumerate(need)}
        edits = []
        for i in pairs:
            text, after = rows[i][3], rows[i + 1][3]
            cut = len(text) // 3
            edits.append((text[: len(text) - cut] + after[:cut]).encode())
        made = signatures([rows[i][3].encode() for i in need] + edits)
        own, after, edited = made[[where[i] for i in pairs]], made[[where[i + 1] for i in pairs]], made[len(need) :]
        columns = [
            pa.array([rows[i][2] for i in pairs], kind), pa.array([len(rows[i][3]) for i in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array(list(map(fingerprint, own)), pa.string()), pa.array(list(map(fingerprint, edited)), pa.string()), pa.array(likeness(own, edited), pa.float64()), pa.array(likeness(own, after), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, kind = [], 0, pa.int64()
        for batch in batches:
            kind = batch.column(2).type
            for row in (x for at in range(0, batch.num_rows, 256) for x in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)):
                waiting.append(row)
                size += len(row[3])
                if size > 2_000_000 and len(waiting) > 1:
                    yield results(waiting, kind)
                    waiting, size = waiting[-1:], len(row[3])
        if len(waiting) > 1:
            yield results(waiting, kind)

    rows = _with_neighbours(docs)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc("key"), "text").select("bucket", "halo", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(trimmed(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
