"""Datasets of prompts, conversations and preferences: scan, filter, sample, format."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import verbs


@dataclass
class PromptOptions:
    """Column names and limits of a prompt dataset."""

    prompt: str = "prompt"
    max_prompt_length: int | None = None
    max_samples: int = -1
    shuffle: bool = False
    seed: int = 0
    readers: dict[str, str] = field(default_factory=lambda: {"parquet": "parquet", "json": "json", "jsonl": "json"})


def read_files(spark: SparkSession, files: str | Sequence[str], options: PromptOptions | None = None) -> DataFrame:
    """Rows of all files, by their extension; columns that a file lacks are null."""
    known = (options or PromptOptions()).readers
    out = None
    for f in [files] if isinstance(files, str) else files:
        kind = f.rstrip("/").rsplit(".", 1)[-1]
        if kind not in known:
            raise ValueError(f"unknown file kind {kind!r}: {f}")
        part = spark.read.format(known[kind]).load(f)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def token_length(text: Column, encode: Callable[[list[str]], list[int]] | None = None) -> Column:
    """The number of tokens of each text: by `encode`, or of runs of word characters and signs. Null where encoding fails."""
    if encode is None:
        return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            try:
                return None if t is None else encode([t])[0]
            except Exception:  # noqa: BLE001  a text that can't be encoded has no length
                return None

        return pd.Series([one(t) for t in texts], dtype="Int32")

    return run(text)


def short_prompts(df: DataFrame, limit: int, text: Column, encode: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Rows whose prompt has `limit` tokens or fewer; prompts without a length go."""
    return df.filter(token_length(text, encode) <= limit)


def prompts(spark: SparkSession, files: str | Sequence[str], order: Sequence[str], options: PromptOptions | None = None) -> DataFrame:
    """Scan, number in `order`, sample, and drop overlong prompts (an array of messages or a string)."""
    o = options or PromptOptions()
    df = verbs.with_row_ids(read_files(spark, files, o), order)
    if o.max_samples > 0:
        df = verbs.sample_rows(df, o.max_samples, o.shuffle, o.seed)
    if o.max_prompt_length is None:
        return df
    kind = df.schema[o.prompt].dataType.simpleString()
    text = F.array_join(F.transform(o.prompt, lambda m: m["content"]), "\n") if kind.startswith("array") else F.col(o.prompt)
    return short_prompts(df, o.max_prompt_length, text)


def _count_of(a: Column, value: str) -> Column:
    return F.size(F.filter(a, lambda x: x == value))


def message_parts(content: Column, images: Column | None = None, videos: Column | None = None) -> Column:
    """array<struct<type, text>> of a message with <image> and <video> marks; counts must match the attached media."""
    pieces = F.filter(F.split(content, "(?=<image>)|(?<=<image>)|(?=<video>)|(?<=<video>)"), lambda p: p != "")
    made = F.transform(pieces, lambda p: F.when(p == "<image>", F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))).when(p == "<video>", F.struct(F.lit("video").alias("type"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("type"), p.alias("text"))))
    for mark, media in (("<image>", images), ("<video>", videos)):
        if media is not None:
            n = _count_of(pieces, mark)
            made = F.when(n == F.coalesce(F.size(media), F.lit(0)), made).otherwise(F.raise_error(F.lit(f"{mark} marks don't match the attached media")).cast("array<struct<type:string,text:string>>"))
    return made


def equal_splits(df: DataFrame, count: int, rows: int | None = None, rest: bool = False) -> DataFrame:
    """Add `split`: contiguous equal splits; the rows must divide evenly, or with rest those left over make a further one."""
    return verbs.chunk(df, count, rows, rest=rest).withColumnRenamed("part", "split")


def supervised(df: DataFrame, prompt_ids: str, response_ids: str, max_length: int, pad_id: int = 0, truncation: str = "error") -> DataFrame:
    """Add input_ids, attention_mask, position_ids, loss_mask, each max_length long.

    The loss mask is 1 from the prompt's last token to the response's last but one.
    """
    ids = F.concat(F.col(prompt_ids), F.col(response_ids))
    n, p = F.size(ids), F.size(F.col(prompt_ids))
    made = df.withColumn("_ids", ids.cast("array<int>")).withColumn("_on", F.transform(ids, lambda _, i: F.when((i >= p - 1) & (i < n - 1), 1).otherwise(0)))
    cut = lambda c: A.truncate(c, max_length, truncation)
    made = made.withColumn("_ids", cut("_ids")).withColumn("_on", cut("_on"))
    one = F.transform("_ids", lambda _: F.lit(1))
    full = lambda c, v: A.pad(c, max_length, F.lit(v))
    mask = full(one, 0)
    return made.withColumn("input_ids", full(F.col("_ids"), pad_id)).withColumn("attention_mask", mask).withColumn("loss_mask", full(F.col("_on"), 0)).withColumn("position_ids", A.positions("attention_mask")).drop("_ids", "_on")


def preference_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two rows a triple: (…, side, response) with side 0 chosen and 1 rejected."""
    others = [c for c in df.columns if c not in (chosen, rejected)]
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("response")) for i, c in enumerate((chosen, rejected))])
    return df.select(*others, F.inline(sides))


def multi_turn(df: DataFrame, messages: str, encode: Callable[[Column], Column], max_length: int, pad_id: int = 0, truncation: str = "right", pad: bool = True) -> DataFrame:
    """Add input_ids, loss_mask, attention_mask, position_ids of chats: encode gives a turn's ids from its struct.

    Only assistant turns count in the loss.
    """
    ids = F.flatten(F.transform(messages, encode))
    on = F.flatten(F.transform(messages, lambda m: F.transform(encode(m), lambda _: F.when(m["role"] == "assistant", 1).otherwise(0))))
    made = df.withColumn("input_ids", A.truncate(ids, max_length, truncation)).withColumn("loss_mask", A.truncate(on, max_length, truncation))
    made = made.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    if pad:
        for c, v in (("input_ids", pad_id), ("loss_mask", 0), ("attention_mask", 0)):
            made = made.withColumn(c, A.pad(c, max_length, F.lit(v)))
    return made.withColumn("position_ids", A.positions("attention_mask"))


def sampler(df: DataFrame, shuffle: bool = False, seed: int = 0, curriculum: Column | None = None) -> DataFrame:
    """Rows in training order as `at`: a curriculum column's, a seeded hash's, or row_id's own."""
    key = curriculum if curriculum is not None else F.xxhash64(F.lit(seed), "row_id") if shuffle else F.col("row_id")
    numbered = verbs.with_row_ids(df.withColumn("_k", key).withColumnRenamed("row_id", "_own"), ["_k", "_own"])
    return numbered.withColumnRenamed("row_id", "at").withColumnRenamed("_own", "row_id").drop("_k")


def load_class(path: str, name: str, base: type = object) -> type:
    """A class from a Python file, checked to be a kind of `base`."""
    spec = importlib.util.spec_from_file_location("tallyweave_user_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, name)
    if not issubclass(found, base):
        raise TypeError(f"{name} is no {base.__name__}")
    return found
