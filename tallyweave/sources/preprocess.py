"""Row maps from raw question sets to the canonical prompt schema.

The schema: data_source, prompt array<struct<role, content>>, ability, reward_model
struct<style, ground_truth>, extra_info map<string, string>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scoring as S

#: Instructions that prompts end with.
STEPS_MARKED = 'Let\'s think step by step and output the final answer after "####".'
STEPS_BOXED = "Let's think step by step and output the final answer within \\boxed{}."
THINK_FIRST = (
    "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. "
    "The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \\boxed{}."
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def canonical(df: DataFrame, source: str | Column, prompt: Column, ability: str, truth: Column, split: str, index: Column, extra: dict[str, Column] | None = None, style: str = "rule", keep: Sequence[str] = ()) -> DataFrame:
    info = {"split": F.lit(split), "index": index.cast("string"), **(extra or {})}
    pairs = [x for k, v in info.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.create_map(*pairs).alias("extra_info"), *keep,
    )


def marked_answers(df: DataFrame, split: str, source: str = "openai/gsm8k", question: str = "question", answer: str = "answer", index: str = "row_id", system: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Questions with answers that end in "#### number"; the number, without commas, is the truth."""
    truth = F.regexp_replace(F.regexp_extract(answer, r"#### (\-?[0-9\.\,]+)", 1), ",", "")
    user = message("user", F.concat(F.col(question), F.lit(" " + STEPS_MARKED)))
    turns = F.array(message("system", F.lit(system)), user) if system else F.array(user)
    return canonical(df, source, turns, "math", truth, split, F.col(index), {"answer": F.col(answer), "question": F.col(question), **(extra or {})})


def with_tools(df: DataFrame, tool: str, agent: str | None = None, interaction: str | None = None) -> DataFrame:
    """Add what a tool, an interaction or an agent loop needs to extra_info."""
    truth = F.col("reward_model.ground_truth")
    more = [F.lit("need_tools_kwargs"), F.lit("true"), F.lit("tools_kwargs"), F.to_json(F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool)))]
    if interaction:
        more += [F.lit("interaction_kwargs"), F.to_json(F.struct(F.lit(interaction).alias("name"), F.element_at("extra_info", "question").alias("query"), truth.alias("ground_truth")))]
    out = df.withColumn("extra_info", F.map_concat("extra_info", F.create_map(*more)))
    return out.withColumn("agent_name", F.lit(agent)) if agent else out


def boxed_answers(df: DataFrame, split: str, source: str = "DigitalLearningGmbH/MATH-lighteval", question: str = "problem", answer: str = "solution", index: str = "row_id") -> DataFrame:
    """Problems whose solution holds a boxed answer, which is the truth."""
    turns = F.array(message("user", F.concat(F.col(question), F.lit(" " + STEPS_BOXED))))
    return canonical(df, source, turns, "math", S.boxed_answer(answer), split, F.col(index))


def clean_context(c: Column) -> Column:
    """Without wiki marks: [title] becomes a full stop, bracketed remarks go, spaces are single."""
    c = F.replace(F.trim(c), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(c, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def sentence_choices(df: DataFrame, split: str, source: str = "Rowan/hellaswag", index: str = "row_id") -> DataFrame:
    """Sentence endings to choose from (activity_label, ctx_a, ctx_b, endings, label); rows without a label go."""
    context = clean_context(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), F.initcap("ctx_b")))
    made = df.filter(F.length("label") > 0)
    choices = F.to_json(F.transform("endings", clean_context))
    return canonical(made, source, F.array(message("user", context)), "commonsense", F.col("label"), split, F.col(index), {"choices": choices}, style="model")


def holdout(df: DataFrame, share: float, seed: int = 0, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test): rows by a seeded hash of their key, so the split doesn't depend on partitions."""
    test = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.filter(~test), df.filter(test)


def first_share(df: DataFrame, share: float, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first `share` of the rows, the rest)."""
    cut = int((rows if rows is not None else df.count()) * share)
    return df.filter(F.col("row_id") < cut), df.filter(F.col("row_id") >= cut)


def search_questions(df: DataFrame, split: str, system: str, prefix: str, index: str = "row_id") -> DataFrame:
    """Questions for search: system and user turns, gold answers from reward_model or golden_answers, sources tagged searchR1_."""
    truth = F.to_json(F.coalesce(F.col("reward_model.ground_truth.target"), F.col("golden_answers")))
    turns = F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix), F.col("question"))))
    return canonical(df, F.concat(F.lit("searchR1_"), F.col("data_source")), turns, "fact-reasoning", truth, split, F.col(index), {"question": F.col("question")})


def image_questions(df: DataFrame, split: str, source: str = "hiyouga/geometry3k", question: str = "problem", answer: str = "answer", images: str = "images", index: str = "row_id") -> DataFrame:
    """Questions about images, which pass through beside the prompt."""
    turns = F.array(message("user", F.concat(F.col(question), F.lit(" " + THINK_FIRST))))
    return canonical(df, source, turns, "math", F.col(answer), split, F.col(index), {"answer": F.col(answer), "question": F.col(question)}, keep=[images])


#: Names of speakers and their roles.
SPEAKERS = {"gpt": "assistant", "human": "user"}


def spoken_turns(df: DataFrame, turns: str = "conversations") -> DataFrame:
    """array<struct<from, value>> turns as a messages column; an unknown speaker is an error."""
    role = lambda t: F.when(t["from"] == "gpt", SPEAKERS["gpt"]).when(t["from"] == "human", SPEAKERS["human"]).otherwise(F.raise_error(F.concat(F.lit("unknown speaker "), F.coalesce(t["from"], F.lit("null")))))
    return df.withColumn("messages", F.transform(turns, lambda t: F.struct(role(t).alias("role"), t["value"].alias("content")))).drop(turns)


def conversations(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Question and answer as a messages column."""
    return df.withColumn("messages", F.array(message("user", F.col(question)), message("assistant", F.col(answer))))


def chat_pairs(df: DataFrame) -> DataFrame:
    """Each (prompt, chosen, rejected) row as two (prompt, response) rows."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def chat_prompts(df: DataFrame, split: str, source: str, index: str = "row_id") -> DataFrame:
    """Prompts for training against a reward model; the chosen response is kept as the truth."""
    return canonical(df, source, F.array(message("user", F.col("prompt"))), "alignment", F.col("chosen"), split, F.col(index), style="model")
