"""SimHash near-duplicates by pivot distance tables (operator 6).

A fingerprint bit is set where more than half of the shingle hashes have it. Fingerprints
that differ in few bits are linked; components of links are the near-duplicate groups.

Search. Equal fingerprints collapse first. Cut into r + 2 pieces of bits, two fingerprints
within r bits agree in two pieces at least, so each is sent
under every combination of two pieces; no pair is lost. Within a task a pivot table
holds the distances of every fingerprint to PIVOTS references. By the triangle inequality a
pair within r has coordinates that differ by r at most: rows are sorted by the first pivot,
compared with the rows in its window only, discarded by the largest difference over the
other pivots, and the survivors verified by their real distance. A task emits links of a
spanning forest, never all pairs. A combination with more rows than HOT is dealt again by
the bits that it doesn't fix, in the same lossless way.

Components are of fingerprints; the smallest doc_id is looked up when they are known.

Defined results: a null or empty text has fingerprint zero; zero is linked like any other.
Rows with a null doc_id link like any other but name no component; where a component has no
other rows its name is null. Repeated rows get equal results. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, text_slices, trimmed
from tallyweave.llm.nearsets import distances, grouped, least_of_components, near_sets, pivot_values, set_prints, stay_rows

#: Bytes of text that a worker holds as Python objects.
SLICE = 1 << 20
#: Rows of one combination above which its rows are dealt again.
HOT = 4096
_M = (1 << 64) - 1


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words; fewer words make one shingle, none make none."""
    words = raw.split()
    if not words:
        return []
    text = b" ".join(words)
    ends, at = [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(text, 42)]
    return [digest(text[a:b], 42) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For rows of hashes that end at `ends`: the bits set in over half of each row's hashes.

    Eight byte lanes are counted at once, in runs of at most 255 hashes so that no lane overflows.
    """
    out = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    runs = -(-sizes[full] // 255)
    of = np.repeat(np.arange(len(full)), runs)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = starts[full][of] + nth * 255
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(j)) & lanes, cuts)
        per = counts.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(per, first, axis=0)
        more = 2 * total > sizes[full][:, None]
        for k in range(8):
            out[full] |= more[:, k].astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the 64-bit SimHash of every whole text."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE):
                hashes = [shingle_hashes(t.encode().lower(), width) for t in part]
                ends = np.cumsum([len(h) for h in hashes])
                flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(ends[-1]))
                fp = majority(flat, ends).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(fp)], names=["doc_id", "fp"])
                done += len(part)

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: int, fixed: int = 0) -> list[int]:
    """Masks of which at least one is equal for any two values that differ in `bits` bits or fewer outside `fixed`.

    The free bits are cut into bits + 2 pieces; two of them at least agree.
    """
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = bits + 2
    cut = [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]
    return [fixed | sum(1 << b for p in two for b in p) for two in combinations(cut, 2)]


def _keyed(df: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each mask: the mask and the value under it."""
    pick = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("under")) for m in masks])
    return df.select("fp", F.explode(pick).alias("k")).select("fp", "k.mask", "k.under")


def close_pairs(fps: np.ndarray, bits: int, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows within `bits` bits, found by the pivot table, a step of the sorted order at a time."""
    table = distances(fps[:, None, :], pivots[None, :, :])
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    last = np.searchsorted(table[:, 0], table[:, 0] + bits, side="right")
    here = np.arange(len(fps))
    for step in range(1, int((last - here).max(initial=1))):
        a = np.flatnonzero(here + step < last)
        for p in range(1, table.shape[1]):
            if not len(a):
                break
            a = a[np.abs(table[a, p] - table[a + step, p]) <= bits]
        if len(a):
            a = a[distances(fps[a], fps[a + step]) <= bits]
            yield order[a], order[a + step]


def spanning_links(fps: np.ndarray, bits: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the close pairs."""
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    out = []
    for left, right in close_pairs(fps, bits, pivots):
        open_ = root[left] != root[right]  # roots were made direct after the last step
        for a, b in zip(left[open_].tolist(), right[open_].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        if open_.any():
            while (root != root[root]).any():
                root = root[root]
    return out


def _block_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between names within each run of rows of equal (mask, under).

    Rows come in that order, as (mask, under, name, fingerprint words...).
    """
    held: list[np.ndarray] = []
    pivots = None

    def links(block: np.ndarray) -> pa.RecordBatch:
        """Of whole runs only."""
        cuts = np.flatnonzero((block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [block.shape[1]]])
        fps = np.ascontiguousarray(block[3:].T).view(np.uint64)
        two = starts[ends - starts == 2]
        near = two[distances(fps[two], fps[two + 1]) <= bits]
        a, b = [block[2, near]], [block[2, near + 1]]
        for i in np.flatnonzero(ends - starts > 2).tolist():
            names = block[2, starts[i] : ends[i]]
            found = np.array(spanning_links(fps[starts[i] : ends[i]], bits, pivots), np.int64).reshape(-1, 2)
            a.append(names[found[:, 0]])
            b.append(names[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        got = np.stack([c.to_numpy() for c in batch.columns])
        pivots = pivot_values(len(got) - 3) if pivots is None else pivots
        other = np.flatnonzero((got[0] != got[0, -1]) | (got[1] != got[1, -1]))
        whole = int(other[-1]) + 1 if len(other) else 0
        if held and (whole or tuple(held[-1][:2, -1]) != tuple(got[:2, 0])):  # what is held ends here or with the next rows
            yield links(np.concatenate([*held, got[:, :whole]], axis=1))
            held = []
        elif whole:
            yield links(got[:, :whole])
        held.append(got[:, whole:].copy())
    if held:
        yield links(np.concatenate(held, axis=1))


def _linked(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): links within the blocks of (mask, under, name, fingerprint words...) rows."""
    dealt = rows.repartition("mask", "under").sortWithinPartitions("mask", "under", "name")
    return dealt.mapInArrow(trimmed(lambda batches: _block_links(batches, bits)), "a long, b long")


def fingerprint_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`; every chain of close pairs is connected by them."""
    importable(distinct.sparkSession)
    linked = lambda rows: _linked(rows.select("mask", "under", F.col("fp").alias("name"), "fp"), bits)
    keyed = _keyed(distinct, block_masks(bits))
    sizes = materialize(keyed.groupBy("mask", "under").count().filter("count > 1"), "simhash-blocks")
    links = linked(keyed.join(sizes.filter(F.col("count") <= HOT).select("mask", "under"), ["mask", "under"], "left_semi"))
    hot = sizes.filter(F.col("count") > HOT).select("mask", "under")
    for mask in [r["mask"] for r in hot.select("mask").distinct().collect()]:  # at most as many as block_masks has
        rows = distinct.withColumn("under", F.col("fp").bitwiseAND(F.lit(mask))).join(hot.filter(F.col("mask") == mask).select("under"), "under", "left_semi")
        links = links.unionByName(linked(_keyed(rows, block_masks(bits, mask & _M))))
    return links.distinct()


def near_duplicates(docs: DataFrame, *, width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, itself included."""
    prints = materialize(fingerprints(docs, width=width), "fingerprints")
    named = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-names")
    links = materialize(fingerprint_links(named.select("fp"), bits), "fingerprint-links")
    of = least_of_components(named, "fp", links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, *, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, row, component_id): components of texts whose five-word shingles are alike by `threshold` or more.

    The prints are sets of shingles here (see nearsets), their Hamming sketches go through pivot tables, and
    what the tables leave is verified on the shingles. No pair is lost, whatever the size of the input.
    """
    importable(docs.sparkSession)
    prints = materialize(set_prints(docs, threshold=threshold, width=width), "set-prints")
    return grouped(prints, near_sets(docs, prints, threshold=threshold, width=width))


def keep_one(docs: DataFrame, *, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The documents of each group's smallest doc_id, with their columns.

    Rows are judged by doc_id and text, so rows that share a doc_id may differ in whether they stay; equal
    rows stay together. Documents without a doc_id go where their group has one and else stay.
    """
    found = near_copies(docs, threshold=threshold, width=width)
    return stay_rows(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
