"""Texts that are alike by the Jaccard likeness of their word shingles, from blocks that they meet in.

Prints. Every row gets prints of its shingle set: the set's digest and size, a parity sketch, and block
keys. Equal sets collapse first. `set_prints` takes the keys from a prefix filter that loses no pair;
other prints with the same columns, such as bands of signatures, are searched in the same way.

Search. Within a block a pair is discarded by its sizes, by a pivot table (the sketches' Hamming
distances to PIVOTS references: coordinates of sketches within a distance differ by it at most) and by
the sketches' own distance, all of which bound the likeness, and else verified on the shingles
themselves. Only verified links unite. A block's first member is compared with all others, then, round by
round, further members with those that verified links have not united with them, until each block is one
component or all of it was compared; so a large group takes no more pairs than it has rows in its blocks.

A block of over TILE rows is not one task's work: its rows are numbered over range partitions and dealt, in
each round, to tiles of TILE rows and MEMBERS members, with copies of rows where several tiles need them; each pair
of the round meets in one tile. Rounds double, so a block of k rows without likes takes about log2(k) of them.

Defined results: null and empty texts have no shingles and are equal to each other. A text of fewer words
than a shingle has one shingle, the whole. Rows are told apart by doc_id and text; rows with a null doc_id
link like any other. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, new_name, release, text_slices, trimmed
from tallyweave.llm.components import component_labels
from tallyweave.llm.minhash import shingles
from tallyweave.llm.ranks import prefix_sums

PIVOTS = 16
#: Words of the sketch that bounds how much two shingle sets differ.
SKETCH = 8
#: Size from which a shingle set is cut into parts, a power of two; sketches of larger sets would tell nothing.
WHOLE = 512
#: Members of a block from which each round of comparisons with the others starts; later rounds double.
ROUNDS = (0, 1, 64, 4096)
#: Rows of a tile, and members that they are compared with.
TILE, MEMBERS = 16_384, 4096
#: Large blocks that are named in a broadcast at most.
NAMED = 100_000
#: Names, of 8 bytes each, that are sent to all tasks at most, to pick texts or shingle sets where they are read.
FEW = 1_000_000
#: Rows from which a run is worked off in pieces.
LONG_RUN = 200_000
#: Bytes of text whose shingles a worker holds.
SLICE = 250_000


def pivot_values(words: int = 1, count: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, a row of words each."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (count, words), dtype=np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def least_of_components(named: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, component_id): the smallest `rep` among the rows of `named` that links (u, v) between keys connect."""
    labels = materialize(component_labels(links), "component-labels")
    of = materialize(named.join(labels.hint("merge"), named[key] == labels["node"], "left").select(key, "rep", F.coalesce("label", key).alias("label")), "component-members")
    least = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    return of.join(least.hint("merge"), "label").select(key, "component_id")


def _remix(x: np.ndarray, k: int) -> np.ndarray:
    """Another hash for each k."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def set_prints(docs: DataFrame, *, threshold: float, width: int) -> DataFrame:
    """(uid, doc_id, row, digest, n, head, part, size, sketch array<long>, prefix array<long>): the parts of every text's set of n different shingles.

    A set of WHOLE hashes or more is cut by their first bits into 2**level parts. If two sets are alike by
    the threshold, so are their shares of some part; a set emits the parts of its level and of the
    levels of larger sets that it can be alike, so that the two have a level in common.
    prefix is the size - ceil(threshold * size) + 1 least hashes of a part: parts alike by the threshold
    share one of them. A bit of sketch is the parity of the hashes that fall on it, so two sketches differ
    in no more bits than the parts in hashes. digest is a hash of the whole set; head marks one row of each
    text, row is the XXH64 of the text and uid a number of the row's own.
    """
    level = lambda n: max(0, n.bit_length() - (WHOLE - 1).bit_length())

    def parts(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(level(len(x)), level(int(len(x) / threshold + 1e-9)) + 1):
            cuts = [int(c) for c in np.searchsorted(x, (np.arange(1, 1 << k) - (1 << k >> 1)) << (64 - k))] if k else []
            for q, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)], strict=True)):
                yield k << 32 | q, x[a:b]

    def keys(texts: list[str], sets: list[np.ndarray], pieces: list[np.ndarray]) -> list[np.ndarray]:
        return [x[: len(x) - math.ceil(threshold * len(x) - 1e-9) + 1] for x in pieces]

    return made_prints(docs, width, parts, keys)


def made_prints(docs: DataFrame, width: int, parts: Callable, keys: Callable) -> DataFrame:
    """Prints of every row: parts(set) gives (number, part) pairs, keys(texts, sets, parts) the block keys of each part."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(2), SLICE):
                sets = _sets(part, width)
                cut = [(i, not k, p, x) for i, s in enumerate(sets) for k, (p, x) in enumerate(parts(s))]
                row = np.array([c[0] for c in cut], np.int64)
                pieces = [c[3] for c in cut]
                size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                mixed = _remix(np.concatenate(pieces).view(np.uint64), 1)
                sketch = np.zeros(len(pieces) * SKETCH, np.uint64)
                at = np.repeat(np.arange(len(pieces)) * SKETCH, size) + (mixed >> np.uint64(6)).astype(np.int64) % SKETCH
                np.bitwise_xor.at(sketch, at, np.uint64(1) << (mixed & np.uint64(63)))
                digest, n = _digests(sets)
                own = pa.array(row + done)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + uid), batch.column(0).take(own), batch.column(1).take(own), pa.array(digest[row]), pa.array(n[row]), pa.array([c[1] for c in cut]), pa.array([c[2] for c in cut], pa.int64()),
                        pa.array(size), _lists(sketch.view(np.int64).reshape(-1, SKETCH)), _lists(keys(part, sets, pieces)),
                    ],
                    names=["uid", "doc_id", "row", "digest", "n", "head", "part", "size", "sketch", "prefix"],
                )
                done += len(part)
                uid += len(part)

    src = docs.select("doc_id", _row(F.col("text")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(trimmed(run), f"uid long, doc_id {src.schema['doc_id'].dataType.simpleString()}, row long, digest long, n long, head boolean, part long, size long, sketch array<long>, prefix array<long>")


def _row(text: Column) -> Column:
    """Tells rows of equal doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of `width` lowered words, for each text."""
    hashes, made = shingles([t.encode().lower() for t in texts], width)
    return [np.unique(x) for x in np.split(hashes.view(np.int64), np.cumsum(made)[:-1])]


def _lists(rows: list[np.ndarray] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set and its size."""
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets), np.uint64, len(sets)).view(np.int64), np.fromiter(map(len, sets), np.int64, len(sets))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, n, shingles array<long>): sorted hashes of the different shingles of `width` lowered words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(0), SLICE):
                sets = _sets(part, width)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _digests(sets)), _lists(sets)], names=["digest", "n", "shingles"])

    return docs.select("text").mapInArrow(trimmed(run), "digest long, n long, shingles array<long>")


def _runs(batches: Iterator[pa.RecordBatch], head: int = 0) -> Iterator[tuple[np.ndarray, bool]]:
    """Columns of longs, a row each, cut between runs of equal values of the first, and whether a run is cut too.

    A run of over LONG_RUN rows comes in pieces; the later ones start with the run's first `head` rows again.
    """
    held: list[np.ndarray] = []
    rows, cut, key = 0, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = np.stack([c.to_numpy() for c in batch.columns])
        other = np.flatnonzero(got[0] != got[0, -1])
        whole = int(other[-1]) + 1 if len(other) else 0
        if held and got[0, 0] != key:  # what is held has ended
            if not cut or rows > head:
                yield np.concatenate(held, axis=1), cut
            held, rows, cut = [], 0, False
        key = got[0, -1]
        if cut and whole:  # the long run ends in this batch
            end = int(np.flatnonzero(got[0] != got[0, 0])[0])
            yield np.concatenate([*held, got[:, :end]], axis=1), True
            held, rows, cut = [], 0, False
            got, whole = got[:, end:], whole - end
        if whole:
            yield np.concatenate([*held, got[:, :whole]], axis=1), False
            held, rows = [], 0
        held.append(got[:, whole:].copy())
        rows += held[-1].shape[1]
        if rows >= LONG_RUN + head:
            run = np.concatenate(held, axis=1)
            yield run, True
            held, rows, cut = [run[:, :head].copy()], head, True
    if held and (not cut or rows > head):
        yield np.concatenate(held, axis=1), cut


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, name, part) of the shingles of a part that several names have; those of the same part and names make one block.

    Rows come ordered, as (shingle, name, part). Blocks whose hashes should be equal only make a larger block.
    A shingle of very many names is a block of its own.
    """
    for (shingle, name, part), cut in _runs(batches):
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(_remix(shingle.view(np.uint64), 5).view(np.int64)), pa.array(name), pa.array(part)], names=["block", "name", "part"])
            continue
        new = _first_of(shingle, name, part)
        shingle, name, part = shingle[new], name[new], part[new]
        starts = np.flatnonzero(_first_of(shingle))
        sizes = np.diff(np.append(starts, len(name)))
        several = np.repeat(sizes > 1, sizes)
        block = np.repeat(np.add.reduceat(_remix(name.view(np.uint64) ^ _remix(part.view(np.uint64), 4), 3), starts).view(np.int64), sizes)[several]
        name, part = name[several], part[several]
        order = np.lexsort((part, name, block))
        block, name, part = block[order], name[order], part[order]
        new = _first_of(block, name, part)
        yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(name[new]), pa.array(part[new])], names=["block", "name", "part"])


#: Marks of a row in a tile: a copy is there for the rows after it only; members are compared with all after them.
COPY, MEMBER = 1, 2


def _candidates(batches: Iterator[pa.RecordBatch], first: int, last: int, threshold: float, tiled: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a block with different labels that may be alike; a is one of its members `first` to `last`, b a later one.

    Of a large block its first `last` members are held, and others as they pass. Rows come ordered, as (block, name, label, n, size, sketch words...),
    tiled ones as (tile, name, label, n, size, marks, sketch words...) with their members first. Sets or parts alike by the threshold have
    sizes in that ratio at least and differ in (1 - t) / (1 + t) of their summed sizes at most.
    """
    share = (1 - threshold) / (1 + threshold)
    pivots = pivot_values(SKETCH)
    for got, _ in _runs(batches, 0 if tiled else last):
        block, name, label, n, size = got[:5]
        sketch = np.ascontiguousarray(got[6 if tiled else 5 :].T).view(np.uint64)
        table = np.stack([distances(sketch, p) for p in pivots])
        starts = np.flatnonzero(_first_of(block))
        sizes = np.diff(np.append(starts, len(block)))
        start = np.repeat(starts, sizes)
        rank = np.arange(len(block)) - start
        later = np.arange(len(block))
        if tiled:
            members = range(int(rank[got[5] & MEMBER != 0].max(initial=-1)) + 1)
        else:
            members = range(first, min(last, int(sizes.max()) - 1))
        for i in members:
            later = later[rank[later] > i]
            a, b = start[later] + i, later
            may = label[a] != label[b]
            if tiled:
                may &= got[5][b] & COPY == 0
            for of in (n, size):
                may &= np.minimum(of[a], of[b]) >= threshold * np.maximum(of[a], of[b]) - 1e-9
            may = np.flatnonzero(may)
            for own in table:
                may = may[np.abs(own[a[may]] - own[b[may]]) <= share * (size[a[may]] + size[b[may]]) + 1e-9]
            may = may[distances(sketch[a[may]], sketch[b[may]]) <= share * (size[a[may]] + size[b[may]]) + 1e-9]
            if len(may):
                yield pa.RecordBatch.from_arrays([pa.array(name[a[may]]), pa.array(name[b[may]])], names=["a", "b"])


def _tiles(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of large blocks, with their rank and their block's size k, dealt to the tiles of a round: adds `tile` and `marks`.

    A row from `first` on is in the tiles of its own TILE ranks and of all runs of MEMBERS members up to its own;
    a member is copied to the tiles of all later ranks as well.
    """
    rank = F.col("rank")
    runs = F.ceil((F.least(F.col("k"), F.lit(last)) - first) / MEMBERS)
    run, chunk = F.floor((rank - first) / MEMBERS), F.floor(rank / TILE)
    place = lambda r, c, copy: F.struct(r.cast("long").alias("run"), c.cast("long").alias("chunk"), F.lit(copy).alias("copy"))
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.least(runs - 1, run).cast("long")), lambda r: place(r, chunk, 0))
    ends = F.floor((F.col("k") - 1) / TILE)
    copies = F.when((rank < last) & (chunk < ends), F.transform(F.sequence((chunk + 1).cast("long"), F.greatest(ends, chunk + 1).cast("long")), lambda c: place(run, c, COPY)))
    dealt = rows.filter(rank >= first).withColumn("_at", F.explode(F.concat(own, F.coalesce(copies, F.array().cast("array<struct<run:bigint,chunk:bigint,copy:int>>")))))
    member = F.when((rank < last) & (run == F.col("_at.run")), MEMBER).otherwise(0)
    return dealt.withColumn("tile", F.xxhash64("block", "_at.run", "_at.chunk")).withColumn("marks", (F.col("_at.copy") + member).cast("long")).drop("_at")


def _pairs(rows: DataFrame, first: int, last: int, threshold: float, tiled: bool) -> DataFrame:
    """(a, b): the candidates of a round."""
    words = [f"s{w}" for w in range(SKETCH)]
    if tiled:
        dealt = _tiles(rows, first, last).select("tile", "name", "label", "n", "size", "marks", *words, "rank").repartition("tile").sortWithinPartitions("tile", "rank").drop("rank")
    else:
        dealt = rows.select("block", "name", "label", "n", "size", *words).repartition("block").sortWithinPartitions("block", "name")
    return dealt.mapInArrow(trimmed(lambda batches: _candidates(batches, first, last, threshold, tiled)), "a long, b long").distinct()


def _large_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of blocks of up to TILE rows, and those of larger blocks with rank (by name, from 0) and k; None where there are none."""
    sizes = materialize(rows.groupBy("block").agg(F.count("*").alias("k")).filter(F.col("k") > TILE), "large-blocks")
    many = sizes.count()
    if not many:
        return rows, None
    named = F.broadcast(sizes) if many <= NAMED else sizes.hint("merge")
    large = prefix_sums(rows.join(named, "block"), ["block"], ["name"], F.lit(1), "rank")
    return rows.join(named, "block", "left_anti"), materialize(large, "near-large")


def _few(names: DataFrame) -> DataFrame:
    """Named in a broadcast where there are FEW at most, so that what they pick isn't shuffled."""
    return F.broadcast(names) if names.count() <= FEW else names.hint("merge")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(name, shingles) of the wanted names, written; texts are picked where they are read."""
    texts = docs.select(F.xxhash64("doc_id").alias("of"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    reps = materialize(wanted.select(F.xxhash64("rep").alias("of")).distinct(), "near-reps")
    texts = texts.join(_few(reps), "of", "left_semi")
    # rows that share a doc_id, or have none, may have other texts too
    sets = shingle_sets(texts, width).groupBy("digest", "n").agg(F.first("shingles").alias("shingles"))
    return materialize(sets.join(wanted.hint("merge"), ["digest", "n"]).select("name", "shingles"), "near-shingles")


def _alike(docs: DataFrame, named: DataFrame, pairs: DataFrame, made: list[DataFrame], threshold: float, width: int) -> DataFrame:
    """(u, v): the pairs of names whose shingles are alike. Sets that earlier rounds made are used again; new ones are added to `made`."""
    asked = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    asked = materialize(asked, "near-asked")
    few, new = _few(asked), asked
    for known in made:
        new = new.join(known.select("name").hint("merge"), "name", "left_anti")
    wanted = materialize(named.join(new.hint("merge"), "name", "left_semi"), "near-wanted")
    used = [known.join(few, "name", "left_semi") for known in made]
    if not made or not wanted.isEmpty():
        made.append(_sets_of(docs, wanted, width))
        used.append(made[-1])
    sets = functools.reduce(DataFrame.unionByName, used)
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.withColumn("_n", common).filter(F.col("_n") >= threshold * (F.size("x") + F.size("y") - F.col("_n")))
    return materialize(alike.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "near-alike")


def _rounds() -> Iterator[tuple[int, int]]:
    yield from pairwise(ROUNDS)
    first = ROUNDS[-1]
    while True:
        yield first, 2 * first
        first *= 2


def _open_rows(rows: DataFrame, labels: DataFrame, first: int) -> DataFrame:
    """The rows, with their labels, of blocks that have members from `first` on and aren't one component; written."""
    rows = rows.drop("label").join(labels.hint("merge"), rows["name"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "name"))
    left = rows.groupBy("block").agg(F.count("*").alias("_k"), F.min("label").alias("x"), F.max("label").alias("y")).filter((F.col("_k") > first + 1) & (F.col("x") != F.col("y")))
    return materialize(rows.join(left.select("block").hint("merge"), "block", "left_semi"), "near-rows")


def near_sets(docs: DataFrame, prints: DataFrame, *, threshold: float, width: int) -> DataFrame:
    """(digest, n, component_id): the smallest doc_id of each set's component of links of likeness `threshold` or more.

    prints: rows as set_prints gives them, written.
    """
    spark = docs.sparkSession
    # a set is named by the row of its smallest doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("odd"), F.col("doc_id").alias("rep"), F.col("uid").alias("name")))
    named = prints.filter("head").groupBy("digest", "n").agg(first.alias("m")).select("digest", "n", "m.rep", "m.name")
    named = materialize(named, "set-names")
    own = prints.join(named.select("name").hint("merge"), prints["uid"] == F.col("name"), "left_semi")
    own = materialize(own.select(F.col("uid").alias("name"), "n", "part", "size", "sketch", "prefix"), "set-own")
    # a shingle of different levels is a different one
    dealt = own.select(F.explode("prefix").alias("shingle"), "name", "part").select(F.col("shingle").bitwiseXOR(F.shiftright("part", 32)).alias("shingle"), "name", "part")
    dealt = dealt.repartition("shingle").sortWithinPartitions("shingle", "name", "part")
    blocks = materialize(dealt.mapInArrow(trimmed(_shared), "block long, name long, part long").distinct(), "near-blocks")
    words = [F.col("sketch")[w].alias(f"s{w}") for w in range(SKETCH)]
    rows = materialize(blocks.join(own.select("name", "part", "n", "size", *words).hint("merge"), ["name", "part"]).select("block", "name", "n", "size", *[f"s{w}" for w in range(SKETCH)]), "near-rows")
    small, large = _large_apart(rows)
    searched = {False: small.withColumn("label", F.col("name"))} | ({True: large.withColumn("label", F.col("name"))} if large is not None else {})
    written, links, labels, made = {False: rows, True: large}, None, None, []
    for first, last in _rounds():
        if labels is not None:
            for tiled, of in list(searched.items()):
                before = written[tiled]
                searched[tiled] = written[tiled] = _open_rows(of, labels, first)
                release(before)
                if searched[tiled].isEmpty():
                    del searched[tiled]
        if not searched:
            break
        pairs = None
        for tiled, of in searched.items():
            some = _pairs(of, first, last, threshold, tiled)
            pairs = some if pairs is None else pairs.unionByName(some)
        pairs = materialize(pairs.distinct() if len(searched) > 1 else pairs, "near-pairs")
        if labels is not None and pairs.isEmpty():
            continue
        alike = _alike(docs, named, pairs, made, threshold, width)
        links = alike if links is None else links.unionByName(alike)
        labels = materialize(component_labels(links), "near-labels")
    if links is None:
        links = spark.createDataFrame([], "u long, v long")
    return least_of_components(named, "name", links).join(named.hint("merge"), "name").select("digest", "n", "component_id")


def grouped(prints: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, row, component_id) of every row of the prints."""
    return prints.filter("head").select("doc_id", "row", "digest", "n").join(of.hint("merge"), ["digest", "n"]).select("doc_id", "row", "component_id")


def stay_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, row) stands in `stays`."""
    doc, row = new_name(docs, "_kept_doc"), new_name(docs, "_kept_row")
    named = materialize(stays.select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct(), "kept-rows")
    same = docs["doc_id"].eqNullSafe(named[doc]) & (_row(docs["text"]) == named[row])
    return docs.join(named.hint("merge"), same, "left_semi")
