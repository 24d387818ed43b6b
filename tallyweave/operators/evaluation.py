"""Rollups of scored samples: prompt by prompt, then by data source."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n]


def bootstrap(values: list, size: int, reducers: list[Callable], draws: int = 1000, seed: int = 42) -> list[tuple[float, float]]:
    """Mean and population deviation of each reducer over seeded subsets drawn with replacement.

    Equal (len(values), size, seed) use the same draws.
    """
    state = np.random.RandomState(seed)
    picks = [state.choice(len(values), size=size, replace=True) for _ in range(draws)]
    got = [[f([values[i] for i in p]) for p in picks] for f in reducers]
    return [(float(np.mean(g)), float(np.std(g))) for g in got]


def majority(pairs: list[tuple]) -> object:
    """Of (vote, value) pairs: the first value of the most frequent vote; ties go to the vote that came first."""
    counts: dict = {}
    for vote, value in pairs:
        have = counts.setdefault(vote, [0, value])
        have[0] += 1
    return max(counts.values(), key=lambda c: c[0])[1]


@lru_cache(maxsize=64)
def _picks(n: int, size: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For prompts of n samples: item numbers of each draw, a row each; a row an item, how often each draw has it; and its first place there, or size."""
    picks = np.random.RandomState(seed).choice(n, size=(draws, size), replace=True)  # as `draws` calls for one row each
    times, first = np.zeros((n, draws), dtype=np.int32), np.full((n, draws), size, dtype=np.int32)
    rows = np.arange(draws)
    for place in range(size - 1, -1, -1):
        times[picks[:, place], rows] += 1
        first[picks[:, place], rows] = place
    return picks, times, first


def _majorities(values: np.ndarray, votes: list, drawn: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """`majority` of each draw: votes are ranked by how often they come, then by their first place, whose value is taken."""
    picks, times, first = drawn
    size = picks.shape[1]
    most = place = None
    groups: dict = {}
    for item, vote in enumerate(votes):
        groups.setdefault(vote, []).append(item)
    for items in groups.values():
        at = first[items].min(axis=0) if len(items) > 1 else first[items[0]]
        rank = (times[items].sum(axis=0) if len(items) > 1 else times[items[0]]) * (size + 1) - at
        if most is None:
            most, place = rank, at
        else:
            place = np.where(rank > most, at, place)
            most = np.maximum(rank, most)
    return values[picks[np.arange(len(picks)), place]]


def _extremes(values: np.ndarray, drawn: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest value of each draw; NaN where it has one."""
    picks, times, _ = drawn
    if np.isnan(values).any():
        return values[picks].max(axis=1), values[picks].min(axis=1)
    order = np.argsort(values, kind="stable")
    held = times[order] > 0
    return values[order[len(order) - 1 - held[::-1].argmax(axis=0)]], values[order[held.argmax(axis=0)]]


def _prompt_metrics(values: list[float], votes: list | None, draws: int, seed: int) -> list[tuple[str, float]]:
    n = len(values)
    out = [(f"mean@{n}", float(np.mean(values)))]
    if n > 1:
        out.append((f"std@{n}", float(np.std(values))))
        array = np.asarray(values)
        for k in subset_sizes(n):
            drawn = _picks(n, k, draws, seed)
            got = dict(zip(("best", "worst"), _extremes(array, drawn), strict=True))
            if votes is not None:
                got["maj"] = _majorities(array, votes, drawn)
            rows = np.stack(list(got.values()))
            for name, mean, std in zip(got, rows.mean(axis=1).tolist(), rows.std(axis=1).tolist(), strict=True):
                out += [(f"{name}@{k}/mean", mean), (f"{name}@{k}/std", std)]
    return out


def rollup(df: DataFrame, variables: list[str], *, source: str = "data_source", uid: str = "uid", order: str = "row_id", vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(data_source, variable, metric, value): per-prompt metrics averaged over a source's prompts, unweighted.

    mean@n, population std@n, and seeded bootstraps of best@k, worst@k and, with a vote column, maj@k.
    A prompt's samples are taken in `order`; null values are left out.
    """
    votes = F.col(vote).cast("string") if vote else F.lit(None).cast("string")
    long = df.select(F.col(source).alias("data_source"), F.col(uid).alias("uid"), F.col(order).alias("o"), votes.alias("vote"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("x"))
    long = long.select("data_source", "uid", "o", "vote", "x.*").filter("value is not null")
    grouped = long.groupBy("data_source", "uid", "variable").agg(F.sort_array(F.collect_list(F.struct("o", "value", "vote"))).alias("s"))
    rows = grouped.select("data_source", "variable", F.col("s.value").alias("values"), F.col("s.vote").alias("votes"))  # one prompt's samples a row
    use_votes = vote is not None

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.iloc[frame["values"].map(len).argsort(kind="stable")].itertuples(index=False):  # those of one size share their draws
                for metric, value in _prompt_metrics(list(r.values), list(r.votes) if use_votes else None, draws, seed):
                    out.append((r.data_source, r.variable, metric, value))
            yield pd.DataFrame(out, columns=["data_source", "variable", "metric", "value"])

    kind = rows.schema["data_source"].dataType.simpleString()
    per = rows.mapInPandas(run, f"data_source {kind}, variable string, metric string, value double")
    return per.groupBy("data_source", "variable", "metric").agg(F.avg("value").alias("value"))


def mean_std_rollup(df: DataFrame, variable: str, *, source: str = "data_source", uid: str = "uid") -> DataFrame:
    """(data_source, n, mean, std): the native part of rollup, mean@n and std@n by samples a prompt."""
    per = df.groupBy(source, uid).agg(F.count(variable).alias("n"), F.avg(variable).alias("m"), F.stddev_pop(variable).alias("s"))
    return per.groupBy(F.col(source).alias("data_source"), "n").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def expected_extreme(values: Column, k: int, best: bool = True) -> Column:
    """What best@k (or worst@k) bootstraps estimate: the exact expectation of the extreme of k draws with replacement."""
    ordered = F.sort_array(values, asc=best)
    n = F.size(values)
    term = lambda x, i: x.cast("double") * (F.pow((i + 1) / n, F.lit(k)) - F.pow(i / n, F.lit(k)))
    return F.aggregate(F.transform(ordered, term), F.lit(0.0), lambda a, x: a + x)


def majority_vote(df: DataFrame, *, uid: str = "uid", vote: str = "pred", value: str = "score", order: str = "row_id") -> DataFrame:
    """(uid, value): the first value of each group's most frequent vote; ties go to the vote that came first."""
    votes = df.groupBy(uid, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("v"))
    return votes.groupBy(uid).agg(F.max_by("v", F.struct("n", (-F.col("first")).alias("f"))).alias("value"))


def source_means(df: DataFrame, scores: str, *, source: str = "data_source") -> DataFrame:
    """(data_source, score): the mean over rows of each row's mean score over its array of responses."""
    per = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(scores)
    return df.groupBy(F.col(source).alias("data_source")).agg(F.avg(per).alias("score"))


def evaluate(df: DataFrame, score: Callable[[Column, Column, Column], Column], *, responses: str = "responses", source: str = "data_source", truth: str = "reward_model.ground_truth") -> DataFrame:
    """(name, value): "test_score/<source>" with the mean over rows of each row's mean score over its responses.

    score(source, response, truth) is a column. Rows without responses take no part.
    """
    scored = df.select(F.col(source).alias("data_source"), F.transform(responses, lambda r: score(F.col(source), r, F.col(truth)).cast("double")).alias("s")).filter(F.size("s") > 0)
    return source_means(scored, "s").select(F.concat(F.lit("test_score/"), "data_source").alias("name"), F.col("score").alias("value"))


def section(variable: str | Column, metric: str | Column, core: str, n_max: Column) -> Column:
    """val-core for the core variable's mean, maj and best at the most samples, else val-aux."""
    variable, metric = (F.col(c) if isinstance(c, str) else c for c in (variable, metric))
    first = F.split(metric, "@")[0].isin("mean", "maj", "best")
    at = metric.contains(F.concat(F.lit("@"), n_max.cast("string")))
    return F.when((variable == core) & first & at, "val-core").otherwise("val-aux")


def samples_per_prompt(df: DataFrame, prompt: str, response: str, order: str) -> DataFrame:
    """One row a prompt with its responses as an array in sample order."""
    return df.groupBy(prompt).agg(F.sort_array(F.collect_list(F.struct(order, response))).alias("t")).select(prompt, F.col(f"t.{response}").alias("responses"))


def informative_groups(df: DataFrame, metric: str, uid: str = "uid") -> DataFrame:
    """Rows of the groups whose metric varies, and of groups of one row."""
    w = Window.partitionBy(uid)
    made = df.withColumn("_n", F.count("*").over(w)).withColumn("_sd", F.stddev_pop(metric).over(w))
    return made.filter((F.col("_sd") > 0) | (F.col("_n") == 1)).drop("_n", "_sd")
