"""Divergence penalties between log-probability arrays, and the coefficient that follows them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import order

KINDS = ("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")


def token_divergence(logp: Column, ref: Column, kind: str) -> Column:
    """Divergence of one token. A trailing "+" changes gradients only, so it is the base kind here."""
    base = kind.removesuffix("+")
    if base in ("kl", "k1"):
        return logp - ref
    if base == "abs":
        return F.abs(logp - ref)
    if base in ("mse", "k2"):
        return 0.5 * (logp - ref) * (logp - ref)
    if base in ("low_var_kl", "k3"):
        d = A.clip(ref - logp, -20.0, 20.0)
        return A.clip(F.exp(d) - d - 1, -10.0, 10.0)
    raise ValueError(f"unknown divergence {kind!r}")


def divergence(logp: str | Column, ref: str | Column, kind: str = "kl") -> Column:
    return F.zip_with(A.col(logp), A.col(ref), lambda a, b: token_divergence(a, b, kind))


def token_rewards(scores: str, old_logp: str, ref_logp: str, ratio: float) -> Column:
    """scores - ratio * (old - ref), token by token."""
    return F.zip_with(scores, divergence(old_logp, ref_logp), lambda s, d: s - ratio * d)


@dataclass
class Coefficient:
    """The penalty's coefficient: fixed, or adaptive where a target is set."""

    value: float
    target: float | None = None
    horizon: float = 10000.0

    def update(self, current: float, steps: int) -> float:
        """Move towards the target by at most a fifth of steps / horizon; says the new value."""
        if self.target is not None:
            self.value *= 1 + min(max(current / self.target - 1, -0.2), 0.2) * steps / self.horizon
        return self.value


def coefficient_path(measured: Column, start: float, target: float, horizon: float, steps: int) -> Column:
    """The adaptive coefficient after each of an array of measured divergences."""
    first = F.struct(F.lit(start).alias("b"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = acc["b"] * (1 + A.clip(x / target - 1, -0.2, 0.2) * steps / horizon)
        return F.struct(b.alias("b"), F.array_append(acc["out"], b).alias("out"))

    return F.aggregate(measured, first, step, lambda acc: acc["out"])


def coefficient_rows(df: DataFrame, measured: str, group: str, by: str, start: float, target: float, horizon: float, steps: int, out: str = "log_coefficient") -> DataFrame:
    """Add `step` (from 1) and the logarithm of the coefficient after each row of its group, in order of `by`.

    Each row multiplies the coefficient by a factor of its own, so logarithms are summed up over range
    partitions, however many rows a group has.
    """
    factor = F.log(1 + A.clip(F.col(measured) / target - 1, -0.2, 0.2) * steps / horizon)
    rank, sofar, first, base = (order.fresh(df, x) for x in ("_rank", "_sofar", "_first", "_base"))
    summed = order.numbered(order.prefix_sums(df, [group, by], factor, sofar), [group, by], rank)
    starts = summed.groupBy(F.col(group).alias("_of")).agg(F.min(rank).alias(first), F.min_by(sofar, rank).alias(base))
    joined = summed.join(starts, F.col(group).eqNullSafe(F.col("_of")))
    made = joined.withColumn("step", F.col(rank) - F.col(first) + 1).withColumn(out, F.lit(math.log(start)) + F.col(sofar) - F.col(base) + factor)
    return made.select(*df.columns, "step", out)


def apply_penalty(df: DataFrame, coefficient: float, kind: str = "kl", *, scores: str = "scores", logp: str = "old_logp", ref: str = "ref_logp", mask: str = "mask") -> DataFrame:
    """Add `rewards`: scores less coefficient times the masked divergence."""
    return df.withColumn("rewards", F.zip_with(scores, A.masked(divergence(logp, ref, kind), mask), lambda s, d: s - coefficient * d))


def batch_divergence(df: DataFrame, kind: str = "kl", *, logp: str = "old_logp", ref: str = "ref_logp", mask: str = "mask") -> DataFrame:
    """One row `kl`: the mean over rows of each row's masked mean divergence."""
    return df.agg(F.avg(A.masked_mean(divergence(logp, ref, kind), mask)).alias("kl"))
