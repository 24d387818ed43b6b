"""Model inputs of fixed width from prompts and responses of natural length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A


def model_inputs(df: DataFrame, prompt_length: int, response_length: int, *, prompt: str = "prompt_ids", response: str = "response_ids", mask: str | None = None, score: Column | None = None, pad_id: int = 0) -> DataFrame:
    """Add prompts (padded and cut on the left), responses, response_mask, input_ids, attention_mask, position_ids, and with a score rm_scores.

    mask: the response's own mask, all ones by default. The score stands on the response's last token; a response
    without tokens has no place for it, and a row without a score has null rm_scores.
    """
    one = lambda c: F.transform(c, lambda _: F.lit(1))
    p, r = A.truncate(prompt, prompt_length, "left"), A.truncate(response, response_length, "right")
    on = A.truncate(mask, response_length, "right") if mask else one(r)
    seen = F.concat(A.pad(one(p), prompt_length, F.lit(0), left=True), A.pad(one(r), response_length, F.lit(0)))
    made = df.withColumn("prompts", A.pad(p, prompt_length, F.lit(pad_id), left=True)).withColumn("responses", A.pad(r, response_length, F.lit(pad_id))).withColumn("response_mask", A.pad(on, response_length, F.lit(0)))
    made = made.withColumn("input_ids", F.concat("prompts", "responses")).withColumn("attention_mask", seen).withColumn("position_ids", A.positions("attention_mask"))
    if score is None:
        return made
    last = F.least(F.size(response), F.lit(response_length)) - 1
    return made.withColumn("rm_scores", F.when(score.isNotNull(), F.transform("responses", lambda _, i: F.when(i == last, score.cast("double")).otherwise(0.0))))
