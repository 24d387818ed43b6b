"""Best-fit packing by swap-based local search (operator 10).

Texts become token ids plus an end id; only documents over the capacity are cut, into full
pieces and a last shorter one. Pieces are dealt by a hash of their ids and their place in the
written table to groups of about GROUP pieces, a number that follows the input. Each group is packed best fit first,
longest first, then improved: between underfull bins a move, a one-for-one or a two-for-one
exchange is made whenever it raises the sum of squared fills, until the emptiest bins are
empty or nothing helps. The bins a group leaves with ROOM tokens of room or more are opened again
and packed once more together with those of other groups, in fewer groups.

Defined results: a null or empty text is the end id alone, one piece of length 1. A null
doc_id packs like any other. Repeated rows are packed as often as they come. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, text_slices, trimmed

CAPACITY = 2048
#: Pieces that one task packs together, about.
GROUP = 20_000
#: Room from which a bin is opened again; 1 opens all that are not full.
ROOM = CAPACITY // 32
#: Bytes of text that a worker holds as Python objects.
SLICE = 4 << 20
#: Words whose ids a worker keeps in each of two generations, about; the older one goes when the newer is full.
CACHE_WORDS = 300_000
#: What sends a word to the whole tokenizer: letters that may have another composed form, white space that splits no word here.
_ODD = re.compile("[^\0-\u024f]|[\x1c-\x1f\x85\xa0]").search
#: The tokenizer's pre-tokens, and the space between the words that are split together.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| ").findall
#: Stands between the ids of words that are looked up together.
_BREAK = b"\xff\xff\xff\xff"

_PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


def _recalled(missing: Iterable, old: dict, new: dict) -> list:
    """Move what the older generation knows to the newer; what neither knows."""
    unknown = []
    for k in missing:
        if (v := old.get(k)) is None:
            unknown.append(k)
        else:
            new[k] = v
    return unknown


class WordIds:
    """Ids of texts by a BPE tokenizer that splits at white space before anything else, with word ends in its tokens.

    The strings of special tokens become their ids, as the library has it; with `special` False they are text.
    ASCII letters are lowered first: the vocabulary has lower case only, its normalizer lowers all
    letters. Words of plain letters are split into the tokenizer's pre-tokens here, all of them in one
    pass, so that a pre-token is encoded once whatever punctuation stands around it; the tokenizer's
    model gets many of them in one call, and each ends with the one token that has the word-end
    mark. Other words go to the whole tokenizer as they are.
    """

    def __init__(self, path: str, special: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special strings are cut out before
        marks = {t.content: i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items() if special and t.special}
        self.specials = {**marks}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None
        self.parts_only = Tokenizer(self.tokenizer.model)
        self.parts_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.is_end[ends] = True
        self.cache: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _learn_parts(self, parts: list[str]) -> None:
        """Add the ids of these pre-tokens."""
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            lines = [some[i : i + 256] for i in range(0, len(some), 256)]
            for line, e in zip(lines, self.parts_only.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
                raw = ids.tobytes()
                self.parts.update(zip(line, [raw[i:j] for i, j in zip([0, *ends], ends)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        together = b" ".join(new).decode().lower()
        plain = new
        if _ODD(together):
            texts = together.split(" ")
            odd = [bool(_ODD(t)) for t in texts]
            plain = [w for w, o in zip(new, odd, strict=True) if not o]
            other = [w for w, o in zip(new, odd, strict=True) if o]
            together = " ".join([t for t, o in zip(texts, odd, strict=True) if not o])
            for at in range(0, len(other), 4096):
                some = other[at : at + 4096]
                for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    self.cache[w] = np.array(e.ids, "<u4").tobytes()
        if not plain:
            return
        split = _PARTS(together)
        if len(self.parts) > CACHE_WORDS:
            self.old_parts, self.parts = self.parts, {}
        self.parts[" "] = _BREAK
        self._learn_parts(_recalled(set(split).difference(self.parts), self.old_parts, self.parts))
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, split)), "<u4")
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == 0xFFFFFFFF) * 4).tolist()
        self.cache.update(zip(plain, [raw[i:j] for i, j in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        cut = [self.cut.split(t) if self.cut and self.cut.search(t) else None for t in texts]
        split = [t.encode().lower().split() if c is None else [w for x in c[::2] for w in x.encode().lower().split()] for t, c in zip(texts, cut, strict=True)]
        words = set().union(*split) if split else set()
        missing = list(words.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.old, self.cache, missing = self.cache, {}, list(words)
        self._learn(_recalled(missing, self.old, self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) if c is None else self._with_specials(c) for x, c in zip(split, cut, strict=True)]

    def _with_specials(self, cut: list[str]) -> bytes:
        """Ids of texts, all words of which are known, with the strings of special tokens between them."""
        get = self.cache.__getitem__
        return b"".join([self.specials[x] if k % 2 else b"".join(map(get, x.encode().lower().split())) for k, x in enumerate(cut)])


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def cut_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's pieces of at most `capacity` ids."""
    importable(docs.sparkSession)
    step, end = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(own.encode(part), done):
                    ids += end
                    for at in range(0, len(ids), step):
                        got = ids[at : at + step]
                        row.append(i)
                        piece.append(at // step)
                        length.append(len(got) // 4)
                        crc.append(zlib.crc32(got))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), _PIECES.format(src.schema["doc_id"].dataType.simpleString()))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what they have left
    rooms: list[int] = []  # the amounts that some bin has left, in order
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, left = len(bins), capacity - n
            bins.append([i])
        else:
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del rooms[at]
            bins[b].append(i)
            left -= n
        if left:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return bins


def _gains(sizes: list[int], room: int, capacity: int) -> np.ndarray:
    """For every document size, whether a bin with this room gets fuller by taking it for none, one or two of its own."""
    out = np.zeros(capacity + 2, np.int32)
    if room:
        one, count = np.unique(np.array(sizes, np.int64), return_counts=True)
        two = np.add.outer(one, one)
        two = np.concatenate([two[np.triu_indices(len(one), 1)], 2 * one[count > 1]])
        given = np.unique(np.concatenate([[0], one, two]))
        np.add.at(out, given + 1, 1)
        np.add.at(out, np.minimum(given + room, capacity) + 1, -1)
    return np.cumsum(out)[: capacity + 1] > 0


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins; every exchange raises the sum of squared fills, so it ends.

    The emptiest bin gives: a document moves to a fuller bin that has room for it, or is
    exchanged for a smaller one, or for two that are together smaller, so that the fuller bin
    gets fuller still. A bin that gave everything is gone. A table of the sizes each bin can take
    finds the takers among all underfull bins; a bin that has none waits until a bin it could
    give to changes. The search ends where nothing helps, or at the least number of bins the
    summed lengths allow.
    """
    least = -(-sum(lengths) // capacity)
    under = [b for b in range(len(bins)) if sum(lengths[i] for i in bins[b]) < capacity]
    own = [bins[b] for b in under]
    fill = np.array([sum(lengths[i] for i in b) for b in own], np.int64)
    takes = np.zeros((capacity + 1, len(own)), bool)
    # different sizes of a bin, filled up with 0, which no bin takes; as many as fit a bin
    width = int((2 * capacity + 0.25) ** 0.5 + 0.5)
    sizes = np.zeros((len(own), width), np.int64)
    waits = np.zeros(len(own), bool)

    def changed(b: int) -> None:
        takes[:, b] = _gains([lengths[i] for i in own[b]], capacity - int(fill[b]), capacity)
        have = sorted({lengths[i] for i in own[b]} - {0})
        sizes[b] = 0
        sizes[b, : len(have)] = have

    for b in range(len(own)):
        changed(b)
    used = max((np.count_nonzero(x) for x in sizes), default=0)
    many = len(bins)
    while many > least:
        order = np.where(waits | (fill == 0) | (fill == capacity), capacity + 1, fill)
        giver = int(order.argmin())
        if order[giver] > capacity:
            break
        mine = sizes[giver][sizes[giver] > 0]
        able = takes[mine].any(axis=0) & (fill >= fill[giver])
        able[giver] = False
        taker = int(np.where(able, fill, -1).argmax())
        if not able[taker] or not (gain := _exchange(own, lengths, giver, taker, capacity - int(fill[taker]))):
            waits[giver] = True
            continue
        fill[giver] -= gain
        fill[taker] += gain
        many -= not own[giver]
        for b in (giver, taker):
            changed(b)
            used = max(used, np.count_nonzero(sizes[b]))
            waits[b] = False
        for b in (giver, taker):
            waits &= ~(takes[:, b][sizes[:, :used]].any(axis=1) & (fill <= fill[b]))
    for b, items in zip(under, own, strict=True):
        bins[b] = items
    return [b for b in bins if b]


def _exchange(bins: list[list[int]], lengths: list[int], giver: int, taker: int, room: int) -> int:
    """Make the taker, which has `room`, as full as one move or exchange with the giver can; says by how much."""
    best, gain = None, 0
    mine: list[int] = []
    for i in sorted(bins[taker], key=lambda i: lengths[i]):
        if len(mine) < 2 or lengths[mine[-2]] != lengths[i]:  # two of a size are all that an exchange takes
            mine.append(i)
    sizes = [lengths[i] for i in mine]
    for n, x in {lengths[x]: x for x in bins[giver]}.items():
        if n <= room and n > gain:
            best, gain = ((x,), ()), n
        at = bisect_left(sizes, n - room)  # the smallest that makes room for x
        if at < len(sizes) and 0 < n - sizes[at] <= room and n - sizes[at] > gain:
            best, gain = ((x,), (mine[at],)), n - sizes[at]
        for k in range(len(sizes)):  # two for one
            if 2 * sizes[k] >= n:
                break
            at = bisect_left(sizes, n - room - sizes[k], k + 1)
            if at < len(sizes) and 0 < (d := n - sizes[k] - sizes[at]) <= room and d > gain:
                best, gain = ((x,), (mine[k], mine[at])), d
    if best is None:
        return 0
    give, take = best
    bins[giver] = [i for i in bins[giver] if i not in give] + list(take)
    bins[taker] = [i for i in bins[taker] if i not in take] + list(give)
    return gain


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, room: int = ROOM) -> DataFrame:
    """Pieces, a written table, with sequence_id, offset: at most `capacity` ids a sequence, offsets gapless from 0.

    A sequence_id is the group's number, the round and the bin's number within the group.
    """
    importable(pieces.sparkSession)
    fields = pieces.columns
    kind = pieces.schema["doc_id"].dataType.simpleString()
    out = f"{_PIECES.format(kind)}, sequence_id long, offset long, open boolean"

    def packer(second: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            lengths = rows["length"].tolist()
            bins = improve(best_fit(lengths, capacity), lengths, capacity)
            seq, offset, leave = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            for b, items in enumerate(bins):
                at = 0
                for i in items:
                    seq[i], offset[i] = b, at
                    at += lengths[i]
                if not second and capacity - at >= room:
                    leave[items] = True
            base = (int(key[0]) * 2 + second) << 24
            return rows[fields].assign(sequence_id=base + seq, offset=offset, open=leave)

        return run

    sizes = pieces.agg(F.count("*").alias("n")).first()["n"]
    groups = max(1, -(-sizes // group))
    # the place tells rows that repeat apart; a written table gives every attempt the same ones
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    first = materialize(pieces.withColumn("_g", spread).groupBy("_g").applyInPandas(packer(False), out), "packed")
    left = first.filter("open").agg(F.count("*").alias("n")).first()["n"]
    again = max(1, -(-left // group))
    late = first.filter("open").select(*fields).withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(again)))
    return first.filter("not open").drop("open").unionByName(late.groupBy("_g").applyInPandas(packer(True), out).drop("open"))


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP, room: int = ROOM) -> DataFrame:
    """Cut and pack all documents; the texts are read and tokenized once, then only piece lengths travel."""
    return pack(materialize(cut_documents(docs, path, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity, group=group, room=room)
