"""Dealing a batch to parallel ranks, running a function on each part, and collecting in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import verbs


def split(df: DataFrame, ranks: int, rows: int | None = None, pad: bool = True, rest: bool = False) -> DataFrame:
    """Add `rank`: contiguous equal parts. With pad the last row is repeated up to a multiple and such rows have `padding` true.

    With rest nothing is repeated: parts have rows // ranks rows, what is left goes on as further parts from number `ranks` on.
    """
    n = rows if rows is not None else df.count()
    if rest:
        return verbs.chunk(df, ranks, rows=n, rest=True).withColumnRenamed("part", "rank")
    extra = -n % ranks if n else 0
    if extra and not pad:
        raise ValueError(f"{n} rows don't divide into {ranks} parts")
    full = verbs.padding(df, extra, "last", rows=n).withColumn("padding", F.col("row_id") >= n)
    return full.withColumn("rank", F.floor(F.col("row_id") / max(1, (n + extra) // ranks)).cast("int"))


def everywhere(df: DataFrame, ranks: int) -> DataFrame:
    """Every row to every rank."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def replicas(df: DataFrame, mapping: Sequence[int]) -> DataFrame:
    """Rows of part `rank` to every worker that the mapping (worker -> part) names; adds `worker`."""
    pairs = df.sparkSession.createDataFrame(list(enumerate(mapping)), "worker int, rank int")
    return df.join(F.broadcast(pairs), "rank")  # a row a worker


def run(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f on each rank's rows, in row order; what it returns keeps its rank.

    A rank's rows are one task's, as a rank's share of a training batch is; f that needs no whole rank goes to `stream`.
    """

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return f(rows.sort_values("row_id")).assign(rank=key[0])

    return df.groupBy("rank").applyInPandas(each, f"{schema}, rank int")


def stream(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f on batches of rows where they are, without a shuffle."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(each, schema)


def collect(df: DataFrame, workers: Sequence[int] | None = None) -> DataFrame:
    """Without padding, and of replicas only those workers' output."""
    if workers is not None:
        df = df.filter(F.col("worker").isin(list(workers))).drop("worker")
    if "padding" in df.columns:
        df = df.filter(~F.col("padding")).drop("padding")
    return df.drop("rank")
