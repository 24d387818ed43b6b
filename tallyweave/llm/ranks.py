"""Distributed prefix sums: range partitions, their totals, and sums within a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, partitions


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before it in `order`, within equal `group` columns.

    Rows are range-partitioned by group and order, so one group may fill many partitions.
    Each partition's totals by group (a partition has few groups or is small) are summed up
    in order, and every row adds its own partition's start to its sum within the partition.
    """
    spark = df.sparkSession
    by = [*group, *order]
    dealt = df.withColumn("_v", value).repartitionByRange(partitions(spark), *by).withColumn("_p", F.spark_partition_id())
    rows = materialize(dealt, f"prefix-{name}")
    totals = rows.groupBy("_p", *group).agg(F.sum("_v").alias("_t"))
    if group:
        before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    else:
        at, made = 0, []
        for r in sorted(totals.collect(), key=lambda r: r["_p"]):  # a row a partition
            made.append((r["_p"], at))
            at += r["_t"]
        starts = F.broadcast(spark.createDataFrame(made, "_p int, _s long"))
    within = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    own = [c for c in df.columns if c != name]
    return summed.join(starts.select("_p", "_s", *group), ["_p", *group]).select(*own, (F.col("_w") + F.col("_s")).cast("long").alias(name))
