"""Sinks for generations and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators import verbs


def dump_generations(df: DataFrame, path: str, step: int, extra: list[str] | None = None) -> None:
    """JSON lines under step=N with input, output, gts, score, step and the extra columns that exist."""
    more = [c for c in extra or [] if c in df.columns]
    made = df.select("input", "output", "gts", "score", *more).withColumn("step", F.lit(step)).withColumn("_dir", F.lit(step))
    made.withColumnRenamed("_dir", "part_step").write.mode("append").partitionBy("part_step").json(path)


def rollout_log(df: DataFrame, prompt: str, response: str, scores: str) -> DataFrame:
    """input, output, gts and the row's summed score, ready to dump."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select(F.col(prompt).alias("input"), F.col(response).alias("output"), F.col("ground_truth").alias("gts"), total.alias("score"))


def sample_generations(df: DataFrame, count: int, seed: int = 42, key: str = "input", draw: str = "numpy") -> DataFrame:
    """`count` rows of a seeded shuffle of the rows in order of their text, with their place in it.

    draw: "numpy" gives numpy's shuffle, which holds a number a row on the driver, as a validation set
    allows; "hash" orders by a hash instead and holds none.
    """
    numbered = verbs.with_row_ids(df, [key])
    if draw == "hash":
        return verbs.hashed_rows(numbered, count, seed)
    order = np.random.RandomState(seed).permutation(df.count())[:count].tolist()
    return verbs.gather(numbered, order)


def metric_rows(metrics: DataFrame, step: Column | int) -> DataFrame:
    """One wide row of metrics as (step, name, value) rows, nested structs with their names joined by "/"."""
    flat = flatten(metrics, "/")
    numbers = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.NumericType)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in numbers])
    at = F.lit(step) if isinstance(step, int) else step
    return flat.select(at.cast("long").alias("step"), F.explode(rows).alias("m")).select("step", "m.*")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs to columns of their own, names joined by sep."""

    def walk(schema: T.StructType, at: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = [*at, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in here)).alias(sep.join(here)))
        return out

    return df.select(*walk(df.schema, []))


def metric_line(metrics: DataFrame) -> DataFrame:
    """(step, line): "step:N - name:value - ..." of (step, name, value) rows, names in order."""
    got = metrics.filter("value is not null").groupBy("step").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("m"))
    pairs = F.transform("m", lambda x: F.concat(x["name"], F.lit(":"), F.format_string("%.3f", x["value"])))
    return got.select("step", F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - "), F.array_join(pairs, " - ")).alias("line"))


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Append (step, name, value) rows as one JSON line a step."""
    got = metrics.groupBy("step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data"))
    got.write.mode("append").json(path)


def ranked_samples(df: DataFrame, descending: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples of a step by score, or score_1, or 0."""
    have = [F.col(c) for c in ("score", "score_1") if c in df.columns]
    score = F.coalesce(*have, F.lit(0.0))
    out = df.orderBy(F.desc(score) if descending else F.asc(score)).offset(offset)
    return out.limit(limit) if limit is not None else out


def by_request(df: DataFrame, request: str, column: str = "request_id") -> DataFrame:
    """Rows of a request id, dashes ignored."""
    return df.filter(F.replace(F.col(column), F.lit("-"), F.lit("")) == request.replace("-", ""))
