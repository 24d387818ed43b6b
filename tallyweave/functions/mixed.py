"""Positions of tokens in sequences that mix text with images and videos: three axes, time, height and width.

A sequence is an array of segments, struct<length int, t int, h int, w int>: a text segment has a length and a null t, an image or
video has its grid of patches, t frames of h by w. `merge` by `merge` patches make one token. Text counts on, the same on all
axes; the tokens of a grid stand at the place where it begins plus their frame, row and column, row by row; what follows begins after the largest
of them. Null arrays give null, empty segments take no place, and grids smaller than a token have none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import ColumnLike, col

_PLACE = "array<array<struct<t:int,h:int,w:int>>>"


def _tokens(segment: Column, start: Column, merge: int) -> tuple[Column, Column]:
    """(array of a segment's positions, the place after it)."""
    rows, columns = F.floor(segment["h"] / merge).cast("int"), F.floor(segment["w"] / merge).cast("int")
    text = segment["t"].isNull()
    n = F.when(text, F.coalesce(segment["length"], F.lit(0))).otherwise(segment["t"] * rows * columns)
    at = lambda k, value: (start + F.when(text, k).otherwise(value)).cast("int")
    place = lambda k: F.struct(at(k, F.floor(k / (rows * columns))).alias("t"), at(k, F.floor(k / columns) % rows).alias("h"), at(k, k % columns).alias("w"))
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), place)).otherwise(F.array().cast("array<struct<t:int,h:int,w:int>>"))
    after = F.when(n <= 0, start).when(text, start + n).otherwise(start + F.greatest(segment["t"], rows, columns))
    return made, after.cast("int")


def mixed_positions(segments: ColumnLike, merge: int = 2) -> Column:
    """array<struct<t, h, w>>: the positions of all tokens, in order; a scan over the segments."""
    first = F.struct(F.lit(0).alias("start"), F.array().cast(_PLACE).alias("out"))

    def step(acc: Column, segment: Column) -> Column:
        made, after = _tokens(segment, acc["start"], merge)
        return F.struct(after.alias("start"), F.array_append(acc["out"], made).alias("out"))

    return F.aggregate(col(segments), first, step, lambda acc: F.flatten(acc["out"]))


def position_delta(positions: Column) -> Column:
    """What the position after the last one exceeds the number of tokens by; 0 for none."""
    return F.coalesce(F.array_max(F.transform(positions, lambda p: F.greatest(p["t"], p["h"], p["w"]))) + 1 - F.size(positions), F.lit(0))
