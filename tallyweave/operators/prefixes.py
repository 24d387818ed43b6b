"""Adjacent rows of one prompt as one prefix with many suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import verbs


def groups(df: DataFrame, uid: str = "uid", prompt: str = "prompt", response: str = "response") -> DataFrame:
    """(group_id, prefix, suffixes, prefix_len, suffix_lens) of each run of adjacent rows with equal uids.

    group_id is the row_id of the run's first row; prompt and response are arrays of ids.
    """
    runs = verbs.run_positions(df, uid, "_at")
    made = runs.groupBy((F.col("row_id") - F.col("_at")).alias("group_id")).agg(F.min_by(prompt, "row_id").alias("prefix"), F.sort_array(F.collect_list(F.struct("row_id", F.col(response).alias("s")))).alias("t"))
    return made.select("group_id", "prefix", F.col("t.s").alias("suffixes"), F.size("prefix").alias("prefix_len"), F.transform("t", lambda x: F.size(x["s"])).alias("suffix_lens"))


def position_ids(df: DataFrame) -> DataFrame:
    """Add position_ids: the prefix counts from 0, and every suffix goes on from the prefix's length."""
    own = F.transform(F.sequence(F.lit(1), F.col("prefix_len")), lambda i: i - 1)
    own = F.when(F.col("prefix_len") > 0, own).otherwise(F.array().cast("array<int>"))
    each = F.transform("suffix_lens", lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.col("prefix_len") + i - 1)).otherwise(F.array().cast("array<int>")))
    return df.withColumn("position_ids", F.concat(own, F.flatten(each)))
