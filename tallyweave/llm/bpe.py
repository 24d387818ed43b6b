"""Byte-level BPE encoding and decoding (operator 7).

Each match of the split pattern is encoded on its own. Its bytes are leaves of a segment
tree whose nodes hold the smallest (pair rank, position), so the root is the leftmost pair
of minimum rank. A merge kills the right neighbour's leaf and recomputes the two pairs that
changed: three point updates of logarithmic depth. Short pieces of like size share one
array of trees and advance together in numpy; long ones use a tree of their own.

Defined results: a null text counts as empty (no tokens; hashes of no bytes). Equal pieces
always get equal ids, so a bounded per-worker cache keeps what a piece was encoded to; it is
emptied when full, which changes no result. Rows repeat as they come and extra columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, text_slices, trimmed

#: Pieces whose ids a worker keeps at most.
CACHE_PIECES = 400_000
#: Above this many bytes a piece gets a tree of its own.
TOGETHER = 64
#: Texts are encoded in slices of about this many bytes.
SLICE_CHARS = 4_000_000
_NONE = np.int32(2**31 - 1)
_BITS = TOGETHER.bit_length() - 1


class Codec:
    """Ranks of a .tiktoken file with the pattern that splits texts before merging."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.findall = regex.compile(pattern).findall
        self.tokens = np.full(max(self.ranks.values()) + 1, b"", object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        ranks = self.ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self._mask = (1 << max(4, (8 * len(pairs)).bit_length())) - 1
        self._keys, self._values = np.full(self._mask + 1, -1, np.int64), np.full(self._mask + 1, _NONE, np.int32)
        left = np.fromiter(pairs.values(), np.int32, len(pairs))
        waiting = np.fromiter(pairs.keys(), np.int64, len(pairs))
        at = self._slot(waiting)
        while len(waiting):  # open addressing: of those that want a free slot the last one written has it
            free = self._keys[at] < 0
            self._keys[at[free]] = waiting[free]
            has = self._keys[at] == waiting
            self._values[at[has]] = left[has]
            waiting, left, at = waiting[~has], left[~has], (at[~has] + 1) & self._mask
        self._byte_pairs = self._rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.cache: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7) >> 22) & self._mask

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where the two don't merge or the right one is missing (-1)."""
        key = left.astype(np.int64) << 20 | (right.astype(np.int64) & 0xFFFFF)
        at = self._slot(key)
        found = self._keys.take(at)
        out = np.where(found == key, self._values.take(at), _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at = (at[open_] + 1) & self._mask if len(at) == len(key) else (at + 1) & self._mask
            found = self._keys.take(at)
            hit = found == key[open_]
            out[open_[hit]] = self._values.take(at[hit])
            on = ~hit & (found >= 0)
            open_, at = open_[on], at[on]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece by a segment tree over its bytes."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, pairs = 1 << 62, self.pairs
        ids = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            rank = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
            return none if rank is None else rank << 32 | i

        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) != none:
            i = root & ((1 << 32) - 1)
            j = after[i]
            ids[i] = root >> 32
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids, as little-endian uint32 bytes, of pieces of at most `size` bytes (a power of two, up to TOGETHER).

        All arrays are flat: node or position x of row r is at r * width + x.
        """
        n, width = len(pieces), size + 1
        lens = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        place = np.arange(size)
        ids = np.full((n, width), -1, np.int32)  # the last column stands for the end
        ids[:, :size] = np.where(place < lens, self.of_byte[raw], -1)
        after = np.where(place + 1 < lens, place + 1, size).astype(np.int32).ravel()
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), n)
        tree = np.full((n, 2 * size), _NONE, np.int32)
        pair = np.where(place + 1 < lens, self._byte_pairs[raw.astype(np.int64) << 8 | np.roll(raw, -1, axis=1)], _NONE)
        tree[:, size:] = np.where(pair < _NONE, pair << _BITS | place, _NONE)
        low = size
        while low > 1:
            low >>= 1
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        ids, tree = ids.ravel(), tree.ravel()
        root = tree.take(rows * (2 * size) + 1)
        while len(rows):
            at, base, of = rows * size, rows * (2 * size), rows * width
            i = root & (TOGETHER - 1)
            j = after.take(at + i)
            merged = root >> _BITS
            k = after.take(at + j)
            h = before.take(at + i)
            ids[of + i] = merged
            ids[of + j] = -1
            after[at + i] = k
            far = k < size
            before[(at + k)[far]] = i[far]
            own = self._rank(merged, ids.take(of + k))
            tree[base + size + j] = _NONE
            tree[base + size + i] = np.where(own < _NONE, own << _BITS | i, _NONE)
            has = np.flatnonzero(h >= 0)
            behind = self._rank(ids.take((of + h)[has]), merged[has])
            tree[(base + size + h)[has]] = np.where(behind < _NONE, behind << _BITS | h[has], _NONE)
            changed = [size + i, size + j, size + np.where(h >= 0, h, i)]
            for _ in range(size.bit_length() - 1):
                changed = [x >> 1 for x in changed]
                for x in changed:
                    pair = base + 2 * x
                    tree[base + x] = np.minimum(tree.take(pair), tree.take(pair + 1))
            root = tree.take(base + 1)
            more = root < _NONE
            rows, root = rows[more], root[more]
        live = ids.reshape(n, width)[:, :size] >= 0
        flat = ids.reshape(n, width)[:, :size][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: set[str]) -> None:
        """Add what these pieces encode to, so that the cache holds all of them."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = list(pieces)
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in new:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            elif len(raw) > TOGETHER:
                self.cache[p] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                names, raws = by_size.setdefault(1 << (len(raw) - 1).bit_length(), ([], []))
                names.append(p)
                raws.append(raw)
        for size, (names, raws) in by_size.items():
            for at in range(0, len(raws), 2048):
                self.cache.update(zip(names[at : at + 2048], self.merge_many(raws[at : at + 2048], size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        split = list(map(self.findall, texts))
        self.learn(set().union(*split) if split else set())
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec for a rank file, loaded once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of texts of about `chars` characters; a longer text is a run of its own."""
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > chars:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every text; null texts have none."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE_CHARS):
                ids = [np.frombuffer(x, "<i4") for x in own.encode(part)]
                ends = np.cumsum([0, *map(len, ids)])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), values], names=["id", "ids"])
                done += len(part)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(trimmed(run), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes they decode to."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE_CHARS):
                ids = own.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(part)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                done += len(part)

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
