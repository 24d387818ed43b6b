"""Tools that responses call, and interactions that answer them: registered by name, run on Arrow batches.

A tool is a function of its arguments, a dictionary; an interaction is a function of the chat so far
and of the truth. What fails gives an error text and no reward, so a bad call never ends a job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import col


@dataclass(frozen=True)
class Tool:
    """run: arguments -> (text, reward); required: names that every call must give."""

    run: Callable[[dict], tuple[str, float]]
    required: tuple[str, ...] = ()
    about: str = ""

    def schema(self, name: str) -> dict:
        """The function schema that prompts describe the tool with."""
        return {"type": "function", "function": {"name": name, "description": self.about, "parameters": {"type": "object", "properties": {r: {"type": "string"} for r in self.required}, "required": list(self.required)}}}


def answered(tools: dict[str, Tool], name: str | None, arguments: str | None) -> tuple[str, float]:
    """(text, reward) of one call; an error's text and 0 where it can't be run."""
    tool = tools.get(name or "")
    if tool is None:
        return f"no tool {name!r}", 0.0
    try:
        given = json.loads(arguments or "{}")
        missing = [r for r in tool.required if r not in given]
        if missing:
            return f"arguments missing: {', '.join(missing)}", 0.0
        text, reward = tool.run(given)
        return str(text), float(reward)
    except Exception as e:  # noqa: BLE001  whatever a tool raises is its answer
        return f"{type(e).__name__}: {e}", 0.0


def run_calls(calls: Column | str, tools: dict[str, Tool]) -> Column:
    """array<struct<text, reward>> of an array<struct<name, arguments>> of calls, in their order; null calls give null."""

    @F.pandas_udf("array<struct<text: string, reward: double>>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [dict(zip(("text", "reward"), answered(tools, c["name"], c["arguments"]), strict=True)) for c in row] for row in batch], dtype=object)

    return run(col(calls))


def next_turn(messages: Column | str, truth: Column | str, interaction: Callable[[list[dict], str | None], tuple[bool, str, float]]) -> Column:
    """struct<done, text, reward>: what an interaction says to each chat; null chats give null."""

    @F.pandas_udf("done boolean, text string, reward double")
    def run(chats: pd.Series, truths: pd.Series) -> pd.DataFrame:
        out = []
        for chat, t in zip(chats, truths, strict=True):
            if chat is None:
                out.append((None, None, None))
                continue
            try:
                done, text, reward = interaction([dict(m) for m in chat], t)
                out.append((bool(done), str(text), float(reward)))
            except Exception as e:  # noqa: BLE001  as for tools
                out.append((True, f"{type(e).__name__}: {e}", 0.0))
        return pd.DataFrame(out, columns=["done", "text", "reward"])

    return run(col(messages), col(truth))
