"""Aggregates over masked tokens and groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A


def tokens(df: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form: a row for each position of the named arrays, with the columns to keep and `pos` from 0."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_t")).select(*keep, "pos", *[F.col("_t")[c].alias(c) for c in columns])


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: n, sum, mean (over n + 1e-8), and var, the unbiased masked variance; var is null under two tokens.

    Sums are taken within each row first, so only one row a partition is shuffled.
    """
    v, m = F.col(values), F.col(mask)
    square = A.array_sum(F.zip_with(v, m, lambda x, k: F.when(k != 0, x.cast("double") * x * k).otherwise(0.0)))
    whole = df.agg(F.sum(A.array_sum(m)).alias("n"), F.sum(A.masked_sum(v, m)).alias("sum"), F.sum(square).alias("sq"))
    mean = F.col("sum") / (F.col("n") + 1e-8)
    about = F.col("sq") - 2 * mean * F.col("sum") + mean * mean * F.col("n")
    return whole.select("n", "sum", mean.alias("mean"), F.when(F.col("n") > 1, about / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)).alias("var"))


def whiten(df: DataFrame, values: str, mask: str, out: str | None = None, shift_mean: bool = True) -> DataFrame:
    """values with the batch's masked mean 0 (kept unless shift_mean) and variance 1, in every place of the arrays."""
    stats = masked_moments(df, values, mask).select(F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    white = F.transform(values, lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8) + (0.0 if shift_mean else F.col("_mean")))
    keep = [c for c in df.columns if c != (out or values)]
    return joined.select(*keep, white.alias(out or values))


def group_stats(score: Column, uid: str) -> dict[str, Column]:
    """Window columns over the rows of a group: count, mean, sample standard deviation, sum, largest."""
    w = Window.partitionBy(uid)
    return {"n": F.count(score).over(w), "mean": F.avg(score).over(w), "std": F.stddev_samp(score).over(w), "sum": F.sum(score).over(w), "max": F.max(score).over(w)}


def group_mean_std(df: DataFrame, score: str, uid: str, eps: float = 1e-6) -> DataFrame:
    """Per group: count, mean and std with its variance clamped to eps or more; single rows give 0 and 1."""
    got = df.groupBy(uid).agg(F.count(score).alias("n"), F.avg(score).alias("m"), F.var_samp(score).alias("v"))
    one = F.col("n") == 1
    return got.select(uid, "n", F.when(one, 0.0).otherwise(F.col("m")).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest(F.col("v"), F.lit(eps)))).alias("std"))


def masked_mean_exact(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row `mean`: masked sum over the mask's sum, without an epsilon; null over no tokens."""
    return df.agg((F.sum(A.masked_sum(values, mask)) / F.sum(A.array_sum(mask))).alias("mean"))


def mean_max_min_std(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))
