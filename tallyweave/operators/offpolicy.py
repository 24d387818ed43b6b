"""Importance weights, rejection masks and diagnostics between two policies' log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A

BOUND = 20.0
OPTIONS = ("token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def _ratio(df: DataFrame, old: str, rollout: str) -> DataFrame:
    return df.withColumn("_lr", F.zip_with(old, rollout, lambda a, b: a - b))


def raw_weights(level: str, mask: str = "mask") -> Column:
    """Unbounded weights from `_lr`: a token's own ratio, or the product over the row in each place."""
    if level == "token":
        return F.transform("_lr", lambda x: F.exp(A.clip(x, -BOUND, BOUND)))
    if level == "sequence":
        whole = F.exp(A.clip(A.masked_sum("_lr", mask), -BOUND, BOUND))
        return A.spread(whole, "_lr")
    raise ValueError(f"unknown level {level!r}")


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, *, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """Add is_weights: masked ratios of at most `threshold`; normalize divides by the batch's mean weight."""
    made = _ratio(df, old, rollout).withColumn("is_weights", F.zip_with(raw_weights(level, mask), mask, lambda w, m: F.least(w * m, F.lit(threshold))))
    if normalize:
        per_row = A.masked_sum("is_weights", mask) / A.array_sum(mask)
        mean = (F.sum(A.masked_sum("is_weights", mask)) / F.sum(A.array_sum(mask))) if level == "token" else F.avg(F.when(A.array_sum(mask) > 0, per_row))
        stats = made.agg(mean.alias("_mean"))
        made = made.crossJoin(F.broadcast(stats)).withColumn("is_weights", F.transform("is_weights", lambda w: w / F.when(F.col("_mean") > 1e-8, F.col("_mean")).otherwise(1.0)))  # one row
    return made.select(*[c for c in df.columns if c != "is_weights"], "is_weights")


def parse_thresholds(options: list[str], spec: str | float) -> list[tuple[float | None, float]]:
    """(lower, upper) for each option: "u" or "l_u" for k1 (lower 1 / u if not given), one bound for k2 and k3.

    One specification serves all options, or there is one each, separated by commas.
    """
    parts = [p.strip() for p in str(spec).split(",")]
    if len(parts) == 1:
        parts *= len(options)
    if len(parts) != len(options):
        raise ValueError(f"{len(options)} options but {len(parts)} thresholds")
    out: list[tuple[float | None, float]] = []
    for option, part in zip(options, parts, strict=True):
        if option not in OPTIONS:
            raise ValueError(f"unknown option {option!r}")
        bounds = [float(x) for x in part.split("_")]
        if any(b <= 0 for b in bounds) or len(bounds) > 2:
            raise ValueError(f"bad threshold {part!r}")
        if option.endswith("k1"):
            upper = bounds[-1]
            out.append((bounds[0] if len(bounds) == 2 else 1 / upper, upper))
        elif len(bounds) == 1:
            out.append((None, bounds[0]))
        else:
            raise ValueError(f"{option} takes one bound, not {part!r}")
    return out


def _statistic(x: Column, kind: str) -> Column:
    if kind == "k1":
        return -x
    return 0.5 * x * x if kind == "k2" else F.exp(x) - 1 - x


def _statistics(kind: str) -> Column:
    return F.transform("_lr", lambda x: _statistic(x, kind))


def _inside(s: Column, kind: str, bounds: tuple[float | None, float]) -> Column:
    low, high = bounds
    return (s <= F.log(F.lit(high))) & (s >= F.log(F.lit(low))) if kind == "k1" else s <= high


def _token_kept(kept: Column, kind: str, bounds: tuple[float | None, float]) -> Column:
    return F.zip_with(kept, F.col("_lr"), lambda m, x: F.when(_inside(_statistic(x, kind), kind, bounds), m).otherwise(0))


def rejection_mask(df: DataFrame, options: str | list[str] = "token_k1", thresholds: str | float = 2.0, *, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """Set the mask to 0 where any option rejects: single tokens, or whole rows by sum, mean or largest statistic."""
    names = [o.strip() for o in options.split(",")] if isinstance(options, str) else list(options)
    made = _ratio(df, old, rollout).withColumn("_lr", F.transform("_lr", lambda x: A.clip(x, -BOUND, BOUND)))
    row_ok = F.lit(True)
    kept = F.col(mask)
    for name, bounds in zip(names, parse_thresholds(names, thresholds), strict=True):
        level, kind = name.rsplit("_", 1)
        if level == "token":
            kept = _token_kept(kept, kind, bounds)
            continue
        per = _statistics(kind)
        total, n = A.masked_sum(per, mask), A.array_sum(mask)
        value = {"seq_sum": total, "seq_mean": total / F.greatest(n, F.lit(1.0)), "seq_max": F.coalesce(F.array_max(A.masked(per, mask)), F.lit(0.0))}[level]
        row_ok = row_ok & _inside(value, kind, bounds)
    final = F.transform(kept, lambda m: F.when(row_ok, m).otherwise(0))
    return made.withColumn(mask, final).select(*df.columns)


def correct(df: DataFrame, level: str | None = "token", threshold: float = 2.0, normalize: bool = False, options: str | list[str] | None = None, thresholds: str | float = 2.0, **columns: str) -> DataFrame:
    """Weights (unless level is None) and the rejection mask (if options are given) in one plan."""
    weighted = importance_weights(df, level, threshold, normalize, **columns) if level else df
    return rejection_mask(weighted, options, thresholds, **columns) if options else weighted


def weight_metrics(df: DataFrame, level: str = "token", threshold: float = 2.0, *, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """One row about the weights before they are cut: mean, std and effective sample size (on weights clamped to the threshold and its inverse), largest, smallest, shares beyond."""
    made = _ratio(df, old, rollout).withColumn("_w", raw_weights(level, mask))
    long = made.select(F.explode(F.arrays_zip(F.col("_w").alias("w"), F.col(mask).alias("m"))).alias("t")).select("t.*").filter("m <> 0")
    low = 1 / threshold
    clamped = A.clip(F.col("w"), low, threshold)
    mean, square = F.avg(clamped), F.avg(clamped * clamped)
    return long.agg(
        F.avg("w").alias("is_mean"), F.max("w").alias("is_max"), F.min("w").alias("is_min"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("is_std"),
        F.avg((F.col("w") > threshold).cast("double")).alias("is_fraction_high"), F.avg((F.col("w") < low).cast("double")).alias("is_fraction_low"), (mean * mean / square).alias("is_ess"),
    )


def rejection_metrics(df: DataFrame, option: str, threshold: str | float, *, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """One row about an option's statistic: mean, largest, smallest, deviation of its clamped values, shares beyond the bounds and masked shares."""
    (low, high) = parse_thresholds([option], threshold)[0]
    level, kind = option.rsplit("_", 1)
    made = _ratio(df, old, rollout).withColumn("_lr", F.transform("_lr", lambda x: A.clip(x, -BOUND, BOUND)))
    per = F.transform("_lr", lambda x: _statistic(x, kind))
    if level == "token":
        values = made.select(F.explode(F.arrays_zip(per.alias("s"), F.col(mask).alias("m"))).alias("t")).select("t.*").filter("m <> 0")
    else:
        total, n = A.masked_sum(per, mask), A.array_sum(mask)
        row = {"seq_sum": total, "seq_mean": total / F.greatest(n, F.lit(1.0)), "seq_max": F.array_max(A.masked(per, mask))}[level]
        values = made.filter(A.array_sum(mask) > 0).select(row.alias("s"))
    up, down = (F.log(F.lit(high)), F.log(F.lit(low))) if kind == "k1" else (F.lit(high), F.lit(float("-inf")))
    clamped = A.clip(F.col("s"), down, up)
    mean, square = F.avg(clamped), F.avg(clamped * clamped)
    return values.agg(
        F.avg("s").alias("mean"), F.max("s").alias("max"), F.min("s").alias("min"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        F.avg((F.col("s") > up).cast("double")).alias("fraction_high"), F.avg((F.col("s") < down).cast("double")).alias("fraction_low"),
    )


def offpolicy_metrics(df: DataFrame, *, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """One row of divergences between the two policies: perplexities, kl, k3, log-perplexity gaps, chi-squared by token and row.

    Rows without tokens are left out.
    """
    made = _ratio(df, old, rollout).filter(A.array_sum(mask) > 0)
    n = A.array_sum(mask)
    mean = lambda c: A.masked_sum(c, mask) / n
    made = made.withColumn("_o", mean(old)).withColumn("_r", mean(rollout)).withColumn("_n", n)
    gap = F.col("_r") - F.col("_o")
    per_token = lambda f: F.sum(A.masked_sum(F.transform("_lr", f), mask)) / F.sum("_n")
    whole = F.exp(A.clip(A.masked_sum("_lr", mask), -BOUND, BOUND))
    return made.agg(
        F.avg(F.exp(-F.col("_o"))).alias("training_ppl"), F.avg(-F.col("_o")).alias("training_log_ppl"),
        (-per_token(lambda x: x)).alias("kl"), F.avg(F.exp(-F.col("_r"))).alias("rollout_ppl"), F.avg(-F.col("_r")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"), F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"), per_token(lambda x: F.exp(x) - x - 1).alias("k3_kl"),
        (per_token(lambda x: F.exp(2 * A.clip(x, -BOUND, BOUND))) - 1).alias("chi2_token"), (F.avg(whole * whole) - 1).alias("chi2_seq"),
    )
