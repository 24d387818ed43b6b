"""Event-time windows with watermarks, over streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, width: str, *aggregates: Column, keys: tuple[str, ...] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    got = _marked(df, ts, late).groupBy(F.window(ts, width).alias("_w"), *keys).agg(*aggregates)
    return got.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in got.columns if c != "_w"])


def sliding(df: DataFrame, width: str, step: str, *aggregates: Column, keys: tuple[str, ...] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    got = _marked(df, ts, late).groupBy(F.window(ts, width, step).alias("_w"), *keys).agg(*aggregates)
    return got.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in got.columns if c != "_w"])


def sessions(df: DataFrame, gap: str, *aggregates: Column, keys: tuple[str, ...] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key that are less than `gap` apart."""
    got = _marked(df, ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*aggregates)
    return got.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in got.columns if c != "_w"])
