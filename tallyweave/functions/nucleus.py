"""Logits cut to their most likely part, and draws from what is left; JVM-side folds over the row's array.

A logit that is cut becomes minus infinity, in its place. Null arrays give null, empty arrays stay empty. Logits
may be minus infinity already; NaN and null logits aren't defined. A cut after a cut sees the probabilities of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import ColumnLike, col, let, log_sum_exp, tempered

_OUT = float("-inf")


def top_k(logits: ColumnLike, k: int, min_keep: int = 1) -> Column:
    """All logits of at least the k-th largest value: ties at the border stay, so more than k may."""

    def cut(own: Column) -> Column:
        least = F.get(F.sort_array(own, asc=False), F.least(F.lit(max(k, min_keep)), F.size(own)) - 1)
        return let(least, lambda least: F.transform(own, lambda x: F.when(x >= least, x).otherwise(_OUT)))

    return let(_doubles(logits), cut)


def _doubles(logits: ColumnLike) -> Column:
    return F.transform(col(logits), lambda x: x.cast("double"))


def _by_likelihood(logits: Column) -> Column:
    """array<struct<x, back>>, largest first; of equal logits the first in the array comes first."""
    return F.sort_array(F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("back"))), asc=False)


def top_p(logits: ColumnLike, p: float, min_keep: int = 1) -> Column:
    """The smallest set of most likely logits whose probabilities sum up to p at least; of equal logits those first in the array are taken.

    The set is a prefix in order of likelihood, so a fold over the sorted array finds its last member, and a comparison with
    it marks the members in place. Weights are relative to the largest one, so that equal shares sum up exactly.
    """
    first = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"), F.lit(float("inf")).alias("x"), F.lit(1).alias("back"))

    def last(own: Column, top: Column, enough: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            taken = F.struct((acc["mass"] + F.exp(z["x"] - top)).alias("mass"), (acc["n"] + 1).alias("n"), z["x"].alias("x"), z["back"].alias("back"))
            return F.when((acc["mass"] < enough) | (acc["n"] < min_keep), taken).otherwise(acc)

        return F.aggregate(_by_likelihood(own), first, step)

    def cut(own: Column) -> Column:
        marked = lambda end: F.transform(own, lambda x, i: F.when((x > end["x"]) | ((x == end["x"]) & (-i >= end["back"])), x).otherwise(_OUT))
        weight = lambda top: p * F.aggregate(own, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return let(F.array_max(own), lambda top: let(weight(top), lambda enough: let(last(own, top, enough), marked)))

    return let(_doubles(logits), cut)


def processed(logits: ColumnLike, temperature: float = 1.0, k: int | None = None, p: float | None = None) -> Column:
    """Logits over the temperature, then cut to the k most likely, then to a nucleus of mass p; cuts outside their range are none."""
    out = tempered(logits, temperature)
    if k is not None and k > 0:
        out = top_k(out, k)
    if p is not None and 0.0 < p < 1.0:
        out = top_p(out, p)
    return out


def kept(logits: ColumnLike) -> Column:
    """The logits that no cut took, in order."""
    return F.filter(col(logits), lambda x: x > _OUT)


def drawn(logits: ColumnLike, u: Column) -> Column:
    """The place (from 0) of the logit in whose share of [0, 1) u lies, shares standing in the array's order; null where all are cut."""
    first = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))

    def place(own: Column, lse: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            take = (x > _OUT) & (acc["found"].isNull() | (acc["mass"] <= u))  # rounding may leave u beyond the last share
            return F.struct((acc["mass"] + F.exp(x - lse)).alias("mass"), (acc["at"] + 1).alias("at"), F.when(take, acc["at"]).otherwise(acc["found"]).alias("found"))

        return F.aggregate(own, first, step, lambda acc: acc["found"])

    return let(_doubles(logits), lambda own: let(log_sum_exp(own), lambda lse: place(own, lse)))
