"""Reward managers: from a score a response to scores on its tokens. By name, so users can add their own."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.functions import scoring as S
from tallyweave.functions.deadline import Failed, Supervised

MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MANAGERS[name] = f
        return f

    return add


def scored(df: DataFrame, manager: str, score: Column, **options) -> DataFrame:
    """Add token scores by the manager of that name."""
    if manager not in MANAGERS:
        raise ValueError(f"unknown reward manager {manager!r}; known: {', '.join(sorted(MANAGERS))}")
    return MANAGERS[manager](df, score, **options)


@register("naive")
def naive(df: DataFrame, score: Column) -> DataFrame:
    """The score on the last token; a response without tokens has no place for it."""
    return df.withColumn("_s", score.cast("double")).withColumn("token_scores", A.last_place("_s", "mask")).drop("_s")


@register("dapo")
def dapo(df: DataFrame, score: Column, limit: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """As naive, with the penalty for overlong responses added; `overlong` says whose it is not 0."""
    made = df.withColumn("_p", S.overlong_penalty(A.array_sum("mask"), limit, buffer, factor)).withColumn("_s", score.cast("double") + F.col("_p"))
    return made.withColumn("token_scores", A.last_place("_s", "mask")).withColumn("overlong", F.col("_p") < 0).drop("_s", "_p")


@register("batch")
def batch(df: DataFrame, score: Column) -> DataFrame:
    """As naive; the score comes from a function over whole batches (see batched)."""
    return naive(df, score)


@register("prime")
def prime(df: DataFrame, score: Column) -> DataFrame:
    """As naive, with 0 where the score failed (null)."""
    return naive(df, F.coalesce(score.cast("double"), F.lit(0.0)))


def batched(f: Callable[[list, list, list], list], source: str, response: str, truth: str) -> Column:
    """Scores by one call a batch: f(sources, responses, truths) gives floats, dicts with a score, or tuples."""

    @F.pandas_udf("double")
    def run(sources: pd.Series, responses: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([number(x) for x in f(sources.tolist(), responses.tolist(), truths.tolist())], dtype=float)

    return run(F.col(source), F.col(response), F.col(truth))


def number(result: object) -> float:
    """A score from what a user's function gave."""
    if isinstance(result, dict):
        result = result["score"]
    return float(result[0] if isinstance(result, tuple | list) else result)


def each(f: Callable, source: str, response: str, truth: str, *, seconds: float | None = None, **kwargs) -> Column:
    """Scores by a user's function of one response; null where it raises.

    With `seconds`, a child process of each task makes the calls, and a call that takes longer, or ends its process, gives
    null too; its neighbours keep their scores.
    """
    if seconds is not None:
        return _within(lambda s, r, g: number(f(s, r, g, **kwargs)), seconds, source, response, truth)

    def guarded(s: str, r: str, g: str) -> float | None:
        try:
            return number(f(s, r, g, **kwargs))
        except Exception:  # noqa: BLE001  a scorer may fail on a response
            return None

    return batched_raw(guarded, source, response, truth)


def _within(f: Callable, seconds: float, source: str, response: str, truth: str) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with Supervised(f, seconds) as call:  # one child a task, and one more for each call that overruns
            for batch in batches:
                out = []
                for row in zip(*batch, strict=True):
                    try:
                        out.append(call(*row))
                    except Failed:
                        out.append(None)
                yield pd.Series(out, dtype=float)

    return run(F.col(source), F.col(response), F.col(truth))


def batched_raw(f: Callable, source: str, response: str, truth: str) -> Column:
    @F.pandas_udf("double")
    def run(sources: pd.Series, responses: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(sources, responses, truths, strict=True)], dtype=float)

    return run(F.col(source), F.col(response), F.col(truth))


def load(path: str, name: str) -> Callable:
    """A user's scoring function from a Python file."""
    spec = importlib.util.spec_from_file_location("tallyweave_user_scores", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)
