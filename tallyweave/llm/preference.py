"""Preference formatting of chat pairs (operator 3), with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role
and text equal) is rendered once as the prompt; what is left of each is its completion, with
the spans of characters that training looks at: the text and end mark of assistant turns.

Defined results: a null role or text counts as empty. Rows without a conv_id belong to no
conversation. Turns are ordered by (turn, role, text), a null turn first; repeated turns are
kept. Equal conversations have two empty completions. An empty table gives no rows. A
conversation is one row here, as a document is. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import new_name

#: How a turn is rendered.
START, MIDDLE, END = "<|start|>", "\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>)."""
    whole = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    made = turns.filter("conv_id is not null").groupBy("conv_id").agg(whole.alias("t"))
    return made.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def mask_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start, length>> over the rendered turns: text and end mark of each turn of `role`."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(START + MIDDLE)
        body = F.length(t["text"]) + len(END)
        span = F.array(F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length")))
        return F.struct((acc["at"] + head + body).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, first, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with prefix_turns, prompt, and for either side its completion and mask spans; the two inputs are dropped."""
    n = common_prefix(F.col(chosen), F.col(rejected))
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    left, right = new_name(pairs, "_chosen_rest"), new_name(pairs, "_rejected_rest")
    out = pairs.withColumn("prefix_turns", n).withColumn(left, rest(F.col(chosen))).withColumn(right, rest(F.col(rejected)))
    keep = [c for c in pairs.columns if c not in (chosen, rejected, "prefix_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")]
    return out.select(
        *keep, "prefix_turns", render(F.slice(chosen, F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        render(F.col(left)).alias("chosen_text"), mask_spans(F.col(left)).alias("chosen_mask"), render(F.col(right)).alias("rejected_text"), mask_spans(F.col(right)).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with its last assistant text replaced.

    The replacement is the last assistant text of the neighbour (conv_id 2k and 2k + 1 are
    neighbours), empty where there is none. Without an assistant turn both sides are equal.
    """
    whole = conversations(turns)
    places = lambda c: F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.element_at(c, i)["role"] == "assistant")
    own = whole.withColumn("_at", F.coalesce(F.array_max(places(F.col("turns"))), F.lit(0)))
    reply = own.filter("_at > 0").select((F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("conv_id"), F.expr("element_at(turns, _at).text").alias("_reply"))
    said = own.join(reply, "conv_id", "left")
    other = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("_at"), F.coalesce("_reply", F.lit(""))).otherwise(t["text"]).alias("text")))
    return said.select("conv_id", F.col("turns").alias("chosen"), other.alias("rejected"))
