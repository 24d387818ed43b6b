"""Helpers shared by the training-data operators: table reads, scratch tables, worker imports."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyweave.scratch import fresh_path as scratch_path
from tallyweave.scratch import materialize, release
from tallyweave.session import importable

__all__ = ["give_back", "importable", "materialize", "new_name", "partitions", "release", "scratch_path", "table", "text_slices", "trimmed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(texts: pa.Array, size: int) -> Iterator[list[str]]:
    """The column's texts in runs of about `size` bytes, nulls as empty ones; a longer text is a run of its own.

    Only one run at a time stands in memory as Python objects.
    """
    ends = pc.binary_length(texts).fill_null(0).to_numpy().astype("int64").cumsum()
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(ends.searchsorted(before + size, side="right")))
        yield [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def trimmed(run: Callable) -> Callable:
    """The function for mapInArrow, with memory that its task no longer uses given back when the task ends.

    Workers are used again for later stages; what allocators keep for one would count against the next.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def give_back() -> None:
    """Return memory that this process no longer uses to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
