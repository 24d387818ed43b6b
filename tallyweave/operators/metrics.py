"""Metrics of a batch of responses, and the reduction of metric streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators.stats import tokens


def response_lengths(df: DataFrame, attention: str = "attention_mask", response: str = "mask") -> DataFrame:
    """Add prompt_length and response_length: the attention mask's sum outside and the response mask's sum inside the response."""
    n = A.array_sum(response)
    return df.withColumn("response_length", n).withColumn("prompt_length", A.array_sum(attention) - n)


def data_metrics(df: DataFrame, *, max_response: int, max_prompt: int, critic: bool = True) -> DataFrame:
    """One row of score, reward, advantage, return, value and length statistics.

    Rows have arrays scores, rewards, advantages, returns, mask (and values), and prompt_length.
    Scores and rewards are those of responses that have tokens; a batch without any is an error.
    """
    made = df.withColumn("_n", A.array_sum("mask")).withColumn("_s", A.array_sum("scores")).withColumn("_r", A.array_sum("rewards"))
    full = F.col("_n") > 0
    three = lambda c, name, cond=None: [f(F.when(cond, c) if cond is not None else c).alias(f"{name}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    some = F.when(F.sum(full.cast("int")) > 0, F.lit(1.0)).otherwise(F.raise_error(F.lit("every response is empty")).cast("double"))
    row = made.agg(
        *three(F.col("_s"), "score", full), *three(F.col("_r"), "reward", full), *three(F.col("_n"), "response_length"), *three(F.col("prompt_length"), "prompt_length"),
        F.avg((F.col("_n") == max_response).cast("double")).alias("response_clip_ratio"), F.avg((F.col("prompt_length") == max_prompt).cast("double")).alias("prompt_clip_ratio"),
        (F.avg((~full).cast("double")) * some).alias("aborted_ratio"), *three(F.col("_n"), "response_length_non_aborted", full),
    )
    names = ["advantages", "returns", *(["values"] if critic else [])]
    long = tokens(df, *names, "mask").filter("mask <> 0")
    stats = [x for c in names for x in three(F.col(c), c)]
    if critic:
        gap = F.col("returns") - F.col("values")
        stats.append((1 - F.var_samp(gap) / (F.var_samp("returns") + 1e-5)).alias("vf_explained_var"))
    return row.crossJoin(long.agg(*stats))  # one row each


def timing_metrics(df: DataFrame, timings: dict[str, float]) -> DataFrame:
    """(name, value): seconds of each phase and milliseconds a token; generation counts response tokens, others all."""
    totals = df.agg(F.sum(A.array_sum("mask")).alias("response"), F.sum(F.col("prompt_length") + A.array_sum("mask")).alias("all"))
    rows = df.sparkSession.createDataFrame(list(timings.items()), "phase string, s double")
    both = rows.crossJoin(totals)  # a row a phase, and one row
    per = F.col("s") * 1000 / F.when(F.col("phase") == "gen", F.col("response")).otherwise(F.col("all"))
    return both.select(F.explode(F.array(F.struct(F.concat(F.lit("timing_s/"), "phase").alias("name"), F.col("s").alias("value")), F.struct(F.concat(F.lit("timing_per_token_ms/"), "phase").alias("name"), per.alias("value")))).alias("m")).select("m.*")


def throughput_metrics(df: DataFrame, seconds: float, devices: int) -> DataFrame:
    """One row: tokens, seconds a step and tokens a second and device."""
    return df.agg(F.sum(F.col("prompt_length") + A.array_sum("mask")).alias("tokens")).select("tokens", F.lit(seconds).alias("seconds"), (F.col("tokens") / (seconds * devices)).alias("throughput"))


def variance_proxies(df: DataFrame, gradient_norm: float) -> DataFrame:
    """One row of gradient variance proxies from old_logp, sum_pi_sq, advantages and mask (and is_weights).

    proxy1 is the squared gradient norm, proxy2 the mean over tokens of squared advantage times what
    is left of 1 - 2 pi + sum of pi squared, proxy3 the share of proxy2 beyond proxy1 a row.
    """
    weights = ["is_weights"] if "is_weights" in df.columns else []
    long = tokens(df, "old_logp", "sum_pi_sq", "advantages", "mask", *weights).filter("mask <> 0")
    w = 1 - 2 * F.exp("old_logp") + F.col("sum_pi_sq")
    square = F.col("is_weights") * F.col("is_weights") if weights else F.lit(1.0)
    proxy2 = F.avg(square * F.col("advantages") * F.col("advantages") * F.greatest(w, F.lit(0.0)))
    rows = df.agg(F.count("*").alias("_rows"))
    made = long.agg(proxy2.alias("proxy2"), F.avg(w * square).alias("w_mean")).crossJoin(rows)  # one row each
    one = gradient_norm * gradient_norm
    extra = F.when(F.col("_rows") > 1, F.greatest(F.lit(0.0), (F.col("proxy2") - one) / (F.col("_rows") - 1)))
    return made.select(F.lit(one).alias("proxy1"), "proxy2", extra.alias("proxy3"), "w_mean")


def probability_gap(df: DataFrame, a: str = "rollout_logp", b: str = "old_logp", mask: str = "mask") -> DataFrame:
    """One row over unmasked tokens' probabilities: largest, mean and deviation of the absolute gap, and their correlation."""
    long = tokens(df, a, b, mask).filter(F.col(mask) != 0)
    gap = F.abs(F.exp(a) - F.exp(b))
    return long.agg(F.max(gap).alias("diff_max"), F.avg(gap).alias("diff_mean"), F.stddev_samp(gap).alias("diff_std"), F.corr(F.exp(a), F.exp(b)).alias("pearson"))


def token_differences(a: str, b: str, mask: str = "mask") -> Column:
    """The number of unmasked places in which two arrays differ."""
    return A.array_sum(F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m")), lambda t: ((t["m"] != 0) & ~t["a"].eqNullSafe(t["b"])).cast("int"))).cast("long")


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): the largest where the name has "max", else the smallest where it has "min", else the mean."""
    got = df.groupBy(name).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_avg"))
    return got.select(F.col(name).alias("name"), F.when(F.col(name).contains("max"), F.col("_hi")).when(F.col(name).contains("min"), F.col("_lo")).otherwise(F.col("_avg")).alias("value"))


def reduce_ranks(df: DataFrame, kind: str) -> DataFrame:
    """(name, value) of (name, rank, pos, value): by position over ranks first for sum and mean, over all for min and max."""
    if kind in ("min", "max"):
        return df.groupBy("name").agg((F.min if kind == "min" else F.max)("value").alias("value"))
    per = df.groupBy("name", "pos").agg(F.avg("value").alias("v"))
    return per.groupBy("name").agg((F.sum if kind == "sum" else F.avg)("v").alias("value"))


#: Metric names with a rule of their own, then name parts in the order they are tried.
NAMED_RULES = {
    "perf/time_per_step": "sum",
    "timing_s/agent_loop/tool_calls/min": "min",
    "timing_s/agent_loop/tool_calls/mean": "avg",
    "timing_s/agent_loop/tool_calls/max": "max",
    "fully_async/count/total_generated_samples": "last",
    "fully_async/count/stale_samples_processed": "last",
    "fully_async/count/stale_trajectory_processed": "last",
    "fully_async/count/current_param_version": "last",
    "fully_async/count/dropped_stale_samples": "last",
    "training/global_step": "last",
}
PART_RULES = [("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("average", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum")]


def rule_of(name: Column) -> Column:
    """The aggregation that a metric's name asks for; the mean where nothing else does."""
    low = F.lower(name)
    rule = F.when(F.lit(False), "")
    for exact, kind in NAMED_RULES.items():
        rule = rule.when(name == exact, kind)
    for part, kind in PART_RULES:
        rule = rule.when(low.contains(part), kind)
    return rule.otherwise("avg")


def aggregate_stream(df: DataFrame) -> DataFrame:
    """(name, rule, value) of (step, name, value, sample_count) rows: one row for several steps of a metric."""
    got = df.groupBy("name").agg(
        F.max_by("value", "step").alias("last"), F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
        (F.sum(F.col("value") * F.col("sample_count")) / F.sum("sample_count")).alias("weighted_avg"),
    )
    rule = rule_of(F.col("name"))
    value = F.when(rule == "last", F.col("last")).when(rule == "sum", F.col("sum")).when(rule == "max", F.col("max")).when(rule == "min", F.col("min")).otherwise(F.col("avg"))
    return got.select("name", rule.alias("rule"), value.alias("value"))


def derived_metrics(df: DataFrame, devices: int) -> DataFrame:
    """Aggregated (name, value) rows with those recomputed that follow from others: length spread, throughput, idle ratio."""
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    wide = df.agg(
        (pick("global_seqlen/max") - pick("global_seqlen/min")).alias("spread"), (pick("perf/total_num_tokens") / (pick("perf/time_per_step") * devices)).alias("through"),
        (pick("timing_s/gen") / pick("timing_s/step")).alias("idle"), F.max((F.col("name") == "global_seqlen/minmax_diff").cast("int")).alias("has_spread"), F.max((F.col("name") == "perf/throughput").cast("int")).alias("has_through"),
    )
    fixed = [F.when(F.col("has_spread") == 1, F.struct(F.lit("global_seqlen/minmax_diff").alias("name"), F.col("spread").alias("value"))), F.when(F.col("has_through") == 1, F.struct(F.lit("perf/throughput").alias("name"), F.col("through").alias("value"))), F.struct(F.lit("trainer/idle_ratio").alias("name"), F.col("idle").alias("value"))]
    made = wide.select(F.explode(F.array(*fixed)).alias("m")).select("m.*").filter("value is not null")
    return df.select("name", "value").join(made.select("name"), "name", "left_anti").unionByName(made)


def sample_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, largest, smallest and exact percentiles 50, 95, 99, by linear interpolation."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.95, 0.99)]))
    return df.agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), p.alias("_p")).select("avg", "max", "min", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def version_span(df: DataFrame, start: str = "version_start", end: str = "version_end") -> DataFrame:
    """One row about rows that were generated while the model's version changed: their share and their largest span; and the number of versions."""
    span = F.col(end) - F.col(start)
    return df.agg(F.avg((span != 0).cast("double")).alias("partial_ratio"), F.max(span).alias("max_span"), F.countDistinct(end).alias("versions"))


def loop_performance(df: DataFrame, generate: str = "generate_s", tools: str = "tool_s") -> DataFrame:
    """One row: least, largest and mean of both phases, and both of the row that took longest in all."""
    three = [f(c).alias(f"{n}_{k}") for c, n in ((generate, "generate"), (tools, "tool")) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    slow = F.max_by(F.struct("row_id", generate, tools), F.struct(F.col(generate) + F.col(tools), -F.col("row_id")))
    return df.agg(*three, slow.alias("_s")).select("*", F.col("_s.row_id").alias("slowest_row"), F.col(f"_s.{generate}").alias("slowest_generate"), F.col(f"_s.{tools}").alias("slowest_tool")).drop("_s")


def schedule(steps: DataFrame, kind: str, warmup: int, total: int, *, floor: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> DataFrame:
    """Add `rate` to rows of `step`: linear warm-up, then constant, cosine, or stable followed by cosine decay ("wsd")."""
    step = F.col("step").cast("double")
    rise = step / max(1, warmup)
    if kind == "constant":
        after = F.lit(1.0)
    elif kind == "cosine":
        x = (step - warmup) / max(1, total - warmup)
        after = F.greatest(F.lit(0.0), (F.cos(F.lit(3.141592653589793) * cycles * 2 * x) + 1) * 0.5 * (1 - floor) + floor)
    elif kind == "wsd":
        hold = int((total - warmup) * stable)
        x = (step - warmup - hold) / max(1, total - warmup - hold)
        decay = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * cycles * 2 * x)))
        after = F.when(step < warmup + hold, 1.0).otherwise((1 - floor) * decay + floor)
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    ramp = floor + (1 - floor) * rise if kind == "wsd" else rise
    return steps.withColumn("rate", F.when(step < warmup, ramp).otherwise(after))


def latest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that of the largest order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
