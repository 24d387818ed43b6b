"""Policy and value losses as queries: one row with the loss and its metrics.

Rows have arrays logp, old_logp, advantages and mask (and is_weights where importance weights
are used). Losses are forward values; clipping constants are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import order
from tallyweave.operators.stats import tokens

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Make a loss available under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOSSES[name] = f
        return f

    return add


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(sorted(LOSSES))}")
    return LOSSES[name](df, **options)


def aggregate_loss(loss: str | Column, mask: str | Column, mode: str = "token-mean", *, scale: float = 1.0, tokens_at_large: float | None = None, rows_at_large: float | None = None, length: float | None = None) -> Column:
    """An aggregate over rows of per-token losses.

    token-mean: all unmasked tokens alike. seq-mean-token-sum and seq-mean-token-mean: rows with
    tokens alike, by their sum or their mean. seq-mean-token-sum-norm: all rows' sums over `length`,
    the padded width. scale: number of parallel parts, for all but the last.
    """
    row, n = A.masked_sum(loss, mask), A.array_sum(mask)
    if mode == "token-mean":
        return F.sum(row) / (F.lit(tokens_at_large) if tokens_at_large else F.sum(n)) * scale
    rows = F.lit(rows_at_large) if rows_at_large else F.sum((n > 0).cast("double"))
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(n > 0, row).otherwise(0.0)) / rows * scale
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(n > 0, row / (n + 1e-8)).otherwise(0.0)) / rows * scale
    if mode == "seq-mean-token-sum-norm":
        return F.sum(row) / (F.lit(length) if length else F.max(F.size(A.col(loss))))
    raise ValueError(f"unknown mode {mode!r}")


def _zip(*columns: str) -> Column:
    return F.arrays_zip(*[F.col(c).alias(c) for c in columns])


def _log_ratio(t: Column, clip: float | None = 20.0) -> Column:
    d = t["logp"] - t["old_logp"]
    return d if clip is None else A.clip(d, -clip, clip)


def _with_weights(df: DataFrame, loss: str = "_loss") -> DataFrame:
    return df.withColumn(loss, F.zip_with(loss, "is_weights", lambda x, w: x * w)) if "is_weights" in df.columns else df


def _token_mean(values: str) -> Column:
    return F.sum(A.masked_sum(values, "mask")) / (F.sum(A.array_sum("mask")) + 1e-8)


@register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 3.0, mode: str = "token-mean", **agg) -> DataFrame:
    """Clipped ratio loss with a cap for negative advantages; metrics clipfrac, kl, clipfrac_lower."""
    ratio = lambda t: F.exp(_log_ratio(t))
    first = lambda t: -t["advantages"] * ratio(t)
    second = lambda t: -t["advantages"] * A.clip(ratio(t), 1 - low, 1 + high)
    clipped = lambda t: F.greatest(first(t), second(t))
    third = lambda t: -t["advantages"] * cap
    made = df.withColumn("_t", _zip("logp", "old_logp", "advantages"))
    made = made.withColumn("_loss", F.transform("_t", lambda t: F.when(t["advantages"] < 0, F.least(third(t), clipped(t))).otherwise(clipped(t))))
    made = made.withColumn("_frac", F.transform("_t", lambda t: (second(t) > first(t)).cast("double"))).withColumn("_kl", F.transform("_t", lambda t: -_log_ratio(t)))
    made = made.withColumn("_low", F.transform("_t", lambda t: ((clipped(t) > third(t)) & (t["advantages"] < 0)).cast("double")))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", mode, **agg).alias("loss"), _token_mean("_frac").alias("clipfrac"), _token_mean("_kl").alias("kl"), _token_mean("_low").alias("clipfrac_lower"))


@register("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2, **agg) -> DataFrame:
    """As vanilla without the cap, with one ratio a row: the exponential of its mean log-ratio, 10 at most before it."""
    made = df.withColumn("_n", F.greatest(A.array_sum("mask"), F.lit(1.0)))
    made = made.withColumn("_lr", A.masked_sum(F.zip_with("logp", "old_logp", lambda a, b: a - b), "mask") / F.col("_n"))
    made = made.withColumn("_r", F.exp(F.least(F.col("_lr"), F.lit(10.0))))
    clipped = A.clip(F.col("_r"), 1 - low, 1 + high)
    made = made.withColumn("_loss", F.transform("advantages", lambda a: F.greatest(-a * F.col("_r"), -a * clipped))).withColumn("_frac", F.transform("advantages", lambda a: (-a * clipped > -a * F.col("_r")).cast("double")))
    made = made.withColumn("_kl", F.zip_with("logp", "old_logp", lambda a, b: b - a))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", "seq-mean-token-mean", **agg).alias("loss"), _token_mean("_frac").alias("clipfrac"), _token_mean("_kl").alias("kl"))


@register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, mode: str = "seq-mean-token-mean", **agg) -> DataFrame:
    """Ratio passed through a sigmoid gate whose temperature depends on the advantage's sign."""

    def loss(t: Column) -> Column:
        tau = F.when(t["advantages"] > 0, tau_pos).otherwise(tau_neg)
        gate = 1 / (1 + F.exp(-tau * (F.exp(_log_ratio(t)) - 1))) * (4.0 / tau)
        return -gate * t["advantages"]

    made = df.withColumn("_t", _zip("logp", "old_logp", "advantages")).withColumn("_loss", F.transform("_t", loss)).withColumn("_kl", F.transform("_t", lambda t: -_log_ratio(t)))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", mode, **agg).alias("loss"), _token_mean("_kl").alias("kl"))


@register("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", **agg) -> DataFrame:
    """-logp times advantage."""
    made = df.withColumn("_loss", F.zip_with("logp", "advantages", lambda p, a: -p * a))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", mode, **agg).alias("loss"))


@register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", **agg) -> DataFrame:
    """-clipped ratio times advantage times logp."""
    loss = lambda t: -A.clip(F.exp(_log_ratio(t)), 1 - low, 1 + high) * t["advantages"] * t["logp"]
    changed = lambda t: (A.clip(F.exp(_log_ratio(t)), 1 - low, 1 + high) != F.exp(_log_ratio(t))).cast("double")
    made = df.withColumn("_t", _zip("logp", "old_logp", "advantages")).withColumn("_loss", F.transform("_t", loss)).withColumn("_frac", F.transform("_t", changed)).withColumn("_kl", F.transform("_t", lambda t: -_log_ratio(t)))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", mode, **agg).alias("loss"), _token_mean("_frac").alias("clipfrac"), _token_mean("_kl").alias("kl"))


@register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One ratio a row: the exponential of its mean log-ratio, clipped on the side that the advantage's sign asks for; mean over rows."""
    n = A.array_sum("mask") + 1e-8

    def bounded(t: Column) -> Column:
        sign = F.signum(t["advantages"].cast("double"))
        d = sign * (t["logp"] - t["old_logp"])
        return F.when(t["mask"] != 0, sign * F.least(d, A.clip(d, -low, high))).otherwise(0.0)

    made = df.withColumn("_t", _zip("logp", "old_logp", "advantages", "mask"))
    made = made.withColumn("_r", F.exp(A.array_sum(F.transform("_t", bounded)) / n)).withColumn("_a", A.masked_sum("advantages", "mask") / n)
    loss = -F.col("_r") * F.col("_a")
    if "is_weights" in df.columns:
        # a row's weight is the geometric mean of its tokens' weights
        loss = loss * F.exp(A.masked_sum(F.transform("is_weights", lambda w: F.log(w + 1e-10)), "mask") / n)
    return made.agg(F.avg(loss).alias("loss"))


def _covariance(df: DataFrame) -> DataFrame:
    """Long form (row_id, pos, logp, old_logp, a, mask, cov): cov is the product of what advantage and logp exceed their masked means by."""
    long = tokens(df, "logp", "old_logp", "advantages", "mask", keep=("row_id",))
    n = F.sum("mask") + 1e-8
    means = long.agg((F.sum(F.col("advantages") * F.col("mask")) / n).alias("_ma"), (F.sum(F.col("logp") * F.col("mask")) / n).alias("_mp"))
    cov = (F.col("advantages") - F.col("_ma")) * (F.col("logp") - F.col("_mp"))
    return long.crossJoin(F.broadcast(means)).withColumn("cov", cov)  # one row


@register("clip_cov")
def clip_cov(df: DataFrame, ratio: float = 0.0002, lower: float = 1.0, upper: float = 5.0, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Clipped loss, less a share of the tokens whose covariance lies strictly between the bounds and which aren't clipped.

    Which of them is taken is decided by a hash of (row_id, pos), the same in every run.
    """
    long = _covariance(df).withColumn("_r", F.exp(F.col("logp") - F.col("old_logp")))
    first, second = -F.col("advantages") * F.col("_r"), -F.col("advantages") * A.clip(F.col("_r"), 1 - low, 1 + high)
    long = long.withColumn("_l1", first).withColumn("_l2", second)
    able = (F.col("mask") > 0) & (F.col("cov") > lower) & (F.col("cov") < upper) & ~(F.col("_l2") > F.col("_l1"))
    count = max(int(ratio * (long.agg(F.sum("mask").alias("n")).first()["n"] or 0)), 1)
    long = long.select("row_id", "pos", "logp", "old_logp", "mask", "_l1", "_l2", F.coalesce(able, F.lit(False)).alias("_able"))
    # the count grows with the tokens, so the cut is a place in a range-partitioned order; tokens that may go come first
    long = order.numbered(long, [F.desc("_able"), F.xxhash64("row_id", "pos"), "row_id", "pos"], "_n")
    long = long.withColumn("_k", F.when(F.col("_able") & (F.col("_n") < count), 0.0).otherwise(1.0))
    loss = F.greatest("_l1", "_l2") * F.col("_k") * F.col("mask")
    n = F.sum("mask")
    return long.agg((F.sum(loss) / n).alias("loss"), (F.sum((1 - F.col("_k")) * F.col("mask")) / (n + 1e-8)).alias("clipfrac"), (F.sum((F.col("old_logp") - F.col("logp")) * F.col("mask")) / (n + 1e-8)).alias("kl"))


@register("kl_cov")
def kl_cov(df: DataFrame, share: float = 0.0002, coefficient: float = 1.0) -> DataFrame:
    """-advantage times ratio, plus a divergence penalty on the tokens of largest covariance: one in 1 / share, one at least."""
    long = _covariance(df).filter("mask <> 0")
    count = max(1, int(long.count() * share))
    placed = order.numbered(long.select("row_id", "pos", "logp", "old_logp", "advantages", "cov"), [F.desc("cov"), "row_id", "pos"], "_n")
    d = F.col("logp") - F.col("old_logp")
    loss = -F.col("advantages") * F.exp(d) + F.when(F.col("_n") < count, coefficient * F.abs(d)).otherwise(0.0)
    return placed.agg(F.avg(loss).alias("loss"), F.avg(F.abs(d)).alias("kl_abs"))


@register("reinforce")
def reinforce(df: DataFrame, mode: str = "seq-mean-token-sum", **agg) -> DataFrame:
    """-advantage times logp, weighted where there are importance weights."""
    made = df.withColumn("_loss", F.zip_with("logp", "advantages", lambda p, a: -p * a))
    return _with_weights(made).agg(aggregate_loss("_loss", "mask", mode, **agg).alias("loss"))


@register("bypass_mode")
def bypass(df: DataFrame, kind: str = "reinforce", **options) -> DataFrame:
    """Weights and rejection against the sampler's log-probabilities, then reinforce or the clipped loss.

    The old log-probabilities are the sampler's (rollout_logp). The clipped loss uses no weights.
    """
    from tallyweave.operators.offpolicy import correct

    loss_options = {k: options.pop(k) for k in ("mode", "low", "high", "cap") if k in options}
    made = correct(df.withColumn("old_logp", F.col("logp")), **options)
    made = made.withColumn("old_logp", F.col("rollout_logp"))
    if kind == "reinforce":
        return reinforce(made, **loss_options)
    return vanilla(made.drop("is_weights"), **loss_options)


def value_loss(df: DataFrame, clip_range: float = 0.5, mode: str = "token-mean", **agg) -> DataFrame:
    """Half the aggregated larger squared error of the value and of the value clipped about the old one."""
    made = df.withColumn("_t", _zip("vpreds", "returns", "values"))
    clipped = lambda t: A.clip(t["vpreds"], t["values"] - clip_range, t["values"] + clip_range)
    square = lambda x: x * x
    own, cut = (lambda t: square(t["vpreds"] - t["returns"])), (lambda t: square(clipped(t) - t["returns"]))
    made = made.withColumn("_loss", F.transform("_t", lambda t: F.greatest(own(t), cut(t)))).withColumn("_frac", F.transform("_t", lambda t: (cut(t) > own(t)).cast("double")))
    return made.agg((0.5 * aggregate_loss("_loss", "mask", mode, **agg)).alias("loss"), _token_mean("_frac").alias("clipfrac"))


def entropy_loss(df: DataFrame, logits: str = "logits", mask: str = "mask", mode: str = "token-mean", **agg) -> DataFrame:
    """The aggregated entropy of an array of logits a token."""
    return df.withColumn("_h", F.transform(logits, A.entropy)).agg(aggregate_loss("_h", mask, mode, **agg).alias("entropy"))


def sft_loss(df: DataFrame, logp: str = "logp", mask: str = "mask") -> DataFrame:
    """-sum of masked logp over the tokens."""
    return df.agg((-F.sum(A.masked_sum(logp, mask)) / F.sum(A.array_sum(mask))).alias("loss"))


def ppo_loss(df: DataFrame, *, loss: str = "vanilla", entropy_weight: float = 0.0, kl_weight: float = 0.0, kl_kind: str = "k3", mode: str = "token-mean", **options) -> DataFrame:
    """Policy loss less the weighted entropy plus the weighted divergence from ref_logp; entropy is an array column."""
    from tallyweave.operators.divergence import divergence

    policy = policy_loss(df, loss, mode=mode, **options).select(F.col("loss").alias("policy"))
    extra = df.withColumn("_k", divergence("logp", "ref_logp", kl_kind) if kl_weight else F.transform("mask", lambda _: F.lit(0.0)))
    extra = extra.withColumn("_e", F.col("entropy") if entropy_weight else F.transform("mask", lambda _: F.lit(0.0)))
    parts = extra.agg(aggregate_loss("_e", "mask", mode).alias("entropy"), aggregate_loss("_k", "mask", mode).alias("kl"))
    return policy.crossJoin(parts).select((F.col("policy") - entropy_weight * F.col("entropy") + kl_weight * F.col("kl")).alias("loss"), "policy", "entropy", "kl")  # one row each
