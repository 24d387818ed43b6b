"""Datasets that grow or are re-weighted while training, and results that are kept for reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_rows(df: DataFrame, new: DataFrame, keep: Column | None = None) -> DataFrame:
    """df with the new rows that pass `keep`; columns that one side lacks are null."""
    return df.unionByName(new.filter(keep) if keep is not None else new, allowMissingColumns=True)


def on_batch(stream: DataFrame, path: str, generate: Callable[[DataFrame], DataFrame]):
    """A streaming writer that appends what `generate` makes of every micro-batch to a parquet table."""

    def grow(batch: DataFrame, number: int) -> None:
        generate(batch).withColumn("from_batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(grow)


def update_weights(weights: DataFrame, scores: DataFrame, rate: float = 0.5, key: str = "row_id") -> DataFrame:
    """(key, weight): a curriculum moves each seen prompt's weight towards how badly it went; others keep theirs."""
    seen = scores.groupBy(key).agg((1 - F.avg("score")).alias("_w"))
    return weights.join(seen, key, "left").select(key, F.when(F.col("_w").isNull(), F.col("weight")).otherwise((1 - rate) * F.col("weight") + rate * F.col("_w")).alias("weight"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def reused(spark: SparkSession, folder: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept for this key (experiment, batch size, samples, step ...); built and written where there is none."""
    path = f"{folder}/{'_'.join(str(k) for k in key)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
