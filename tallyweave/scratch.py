"""Tables that outlive a query's plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a temporary folder."""
    global _OWN
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    return _OWN


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tallyweave/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the driver
        for spark, path in _WRITTEN:
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def release(df: DataFrame) -> None:
    """Delete what `materialize` wrote for this very DataFrame, once nothing reads it any more."""
    path = vars(df).get("scratch_path")
    if path:
        remove(df.sparkSession, path)
