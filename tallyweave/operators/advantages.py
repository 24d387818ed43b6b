"""Advantage estimators over (row_id, uid, rewards, mask, ...) rows with per-token arrays.

Each adds `advantages` and `returns`. A row's score is the unmasked sum of its rewards; group
statistics are window aggregates over `uid`, so no join is needed and one shuffle serves all
of them. Null rewards count as 0. The rules for groups of one row differ by estimator and
are stated with each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import order
from tallyweave.operators.stats import group_stats, whiten

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Make an estimator available under a name; a name stands for one function only."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name!r} is taken")
        ESTIMATORS[name] = f
        return f

    return add


def advantages(df: DataFrame, estimator: str, **options) -> DataFrame:
    """Add advantages and returns by the estimator of that name."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[estimator](df, **options)


def _masked_spread(value: Column) -> Column:
    return F.transform("mask", lambda m: value * m)


def _both(df: DataFrame, value: Column, columns: list[str]) -> DataFrame:
    made = df.withColumn("advantages", _masked_spread(value))
    return made.select(*columns, "advantages", F.col("advantages").alias("returns"))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("_s", A.array_sum("rewards"))


@register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantage estimation; masked tokens are skipped with the state carried on.

    Returns are taken before the advantages are whitened over the batch; the latter are not masked again.
    """
    rows = F.arrays_zip(F.col("rewards").alias("r"), F.col("values").alias("v"), F.col("mask").alias("m"))

    def step(s: Column, x: Column) -> dict[str, Column]:
        delta = x["r"] + gamma * s["v"] - x["v"]
        on = x["m"] != 0
        return {"v": F.when(on, x["v"].cast("double")).otherwise(s["v"]), "a": F.when(on, delta + gamma * lam * s["a"]).otherwise(s["a"])}

    raw = A.reverse_scan(rows, {"v": F.lit(0.0), "a": F.lit(0.0)}, step, "a")
    made = df.withColumn("advantages", raw).withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whiten(made, "advantages", "mask").select(*df.columns, "advantages", "returns")


@register("grpo")
def grpo(df: DataFrame, by_std: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """Score less the group's mean, over its sample deviation plus epsilon; a single row has mean 0 and deviation 1."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    one = g["n"] == 1
    value = F.col("_s") - F.when(one, 0.0).otherwise(g["mean"])
    return _both(made.withColumn("_a", value / (F.when(one, 1.0).otherwise(g["std"]) + epsilon) if by_std else value), F.col("_a"), df.columns)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, by_std: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """As grpo, with the variance clamped to epsilon or more first."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    one = g["n"] == 1
    value = F.col("_s") - F.when(one, 0.0).otherwise(g["mean"])
    std = F.when(one, 1.0).otherwise(F.sqrt(F.greatest(g["std"] * g["std"], F.lit(epsilon))))
    return _both(made.withColumn("_a", value / (std + epsilon) if by_std else value), F.col("_a"), df.columns)


@register("grpo_passk")
def grpo_passk(df: DataFrame, by_std: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """The group's best row gets its lead over the second, others 0. Ties go to the smaller row_id; a single row is an error."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    order = Window.partitionBy("uid").orderBy(F.desc("_s"), "row_id")
    lead = F.col("_s") - F.lead("_s").over(order)
    best = F.when(F.row_number().over(order) == 1, lead / (g["std"] + epsilon) if by_std else lead).otherwise(0.0)
    value = F.when(g["n"] < 2, F.raise_error(F.concat(F.lit("one row only in group "), F.col("uid").cast("string"))).cast("double")).otherwise(best)
    return _both(made.withColumn("_a", value), F.col("_a"), df.columns)


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    """Score less the group's mean (0 for a single row), whitened over the batch's tokens and masked."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    made = made.withColumn("_a", F.col("_s") - F.when(g["n"] == 1, 0.0).otherwise(g["mean"])).withColumn("advantages", _masked_spread(F.col("_a")))
    made = whiten(made, "advantages", "mask").withColumn("advantages", A.masked("advantages", "mask"))
    return made.select(*df.columns, "advantages", F.col("advantages").alias("returns"))


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """(Score - mean) n / (n - 1); a single row keeps its score."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    value = F.when(g["n"] > 1, (F.col("_s") - g["mean"]) * g["n"] / (g["n"] - 1)).otherwise(F.col("_s"))
    return _both(made.withColumn("_a", value), F.col("_a"), df.columns)


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """(n score - sum) / max(n - 1, 1); a single row gets 0."""
    made = _scored(df)
    g = group_stats(F.col("_s"), "uid")
    return _both(made.withColumn("_a", (g["n"] * F.col("_s") - g["sum"]) / F.greatest(g["n"] - 1, F.lit(1))), F.col("_a"), df.columns)


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the group's mean weighted by response length; a single row has baseline 0.

    A group of several rows without an unmasked token has no baseline: its values are NaN, as 0 / 0 is.
    """
    made = _scored(df).withColumn("_n", A.array_sum("mask"))
    w = Window.partitionBy("uid")
    base = F.try_divide(F.sum(F.col("_n") * F.col("_s")).over(w), F.sum("_n").over(w))
    base = F.when(F.sum("_n").over(w) == 0, F.lit(float("nan"))).otherwise(base)
    return _both(made.withColumn("_a", F.col("_s") - F.when(F.count("*").over(w) == 1, 0.0).otherwise(base)), F.col("_a"), df.columns)


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns whose running value a masked token sets to 0; advantages are their whitened, masked form."""
    rows = F.arrays_zip(F.col("rewards").alias("r"), F.col("mask").alias("m"))
    raw = A.reverse_scan(rows, {"g": F.lit(0.0)}, lambda s, x: {"g": (x["r"] + gamma * s["g"]) * x["m"], "out": x["r"] + gamma * s["g"]}, "out")
    made = whiten(df.withColumn("returns", raw).withColumn("advantages", F.col("returns")), "advantages", "mask")
    return made.withColumn("advantages", A.masked("advantages", "mask")).select(*df.columns, "advantages", "returns")


@register("remax")
def remax(df: DataFrame, baseline: str = "reward_baselines") -> DataFrame:
    """Sums of the rewards from each token on, less the row's baseline on unmasked tokens."""
    rows = F.arrays_zip(A.masked("rewards", "mask").alias("r"), F.col("mask").alias("m"))
    made = df.withColumn("returns", A.reverse_scan(rows, {"g": F.lit(0.0)}, lambda s, x: {"g": s["g"] + x["r"]}, "g"))
    return made.withColumn("advantages", F.zip_with("returns", "mask", lambda g, m: g - F.col(baseline) * m)).select(*df.columns, "advantages", "returns")


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """(Score - mean) times the batch's rows over its rows of nonzero score; a single row has mean 0."""
    made = _scored(df)
    scale = made.agg((F.count("*") / F.greatest(F.sum((F.col("_s") != 0).cast("int")), F.lit(1))).alias("_alpha"))
    g = group_stats(F.col("_s"), "uid")
    made = made.withColumn("_d", F.col("_s") - F.when(g["n"] == 1, 0.0).otherwise(g["mean"])).crossJoin(F.broadcast(scale))  # one row
    return _both(made, F.col("_alpha") * F.col("_d") / f_norm, df.columns)


def _optimal_baseline(df: DataFrame, zero_tail: bool, compact: bool, epsilon: float) -> DataFrame:
    """The optimal-token-baseline estimators; see their docstrings.

    Running sums stay in the rows' arrays. Only sums by (group, position) are shuffled, pre-aggregated, and
    come back as one array a group.
    """
    names = {"r": "rewards", "m": "mask", "o": "old_logp", "p": "sum_pi_sq"} | ({"w": "is_weights"} if "is_weights" in df.columns else {})
    whole = F.arrays_zip(*[F.col(c).alias(k) for k, c in names.items()])
    energy = lambda x: (1 - 2 * F.exp(x["o"]) + x["p"]) * (x["w"] * x["w"] if "w" in names else 1.0) * x["m"]
    made = df.withColumn("_ret", A.reverse_scan(whole, {"g": F.lit(0.0)}, lambda s, x: {"g": s["g"] + F.coalesce(x["r"] * x["m"], F.lit(0.0))}, "g"))
    made = made.withColumn("_t", F.arrays_zip(F.col("_ret").alias("ret"), F.transform(whole, energy).alias("e"), F.col("mask").alias("m")))
    if compact:
        made = made.withColumn("_t", F.filter("_t", lambda x: x["m"] != 0))
    made = made.withColumn("_w", A.running(F.transform("_t", lambda x: x["e"]))).withColumn("_len", A.array_sum("mask"))
    one = made.select("uid", F.posexplode(F.arrays_zip(F.col("_t").alias("t"), F.col("_w").alias("w"))).alias("at", "x")).select("uid", "at", F.col("x.t.ret").alias("ret"), (F.col("x.w") * F.col("x.t.m")).alias("w"))
    places = one.groupBy("uid", "at").agg((F.sum(F.col("ret") * F.col("w")) / (F.sum("w") + epsilon)).alias("b"))
    base = places.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "b"))).alias("_b")).select(F.col("uid").alias("_u"), F.col("_b.b").alias("_b"))
    lens = made.groupBy("uid", "_len").agg(F.count("*").alias("n")).groupBy("uid").agg(F.sum("n").alias("_rows"), F.max("_len").alias("_top"), F.max_by("n", "_len").alias("_tops"), F.slice(F.sort_array(F.collect_set("_len"), False), 2, 1).alias("_second"))
    lens = lens.withColumnRenamed("uid", "_v")
    got = made.join(lens, F.col("uid").eqNullSafe(F.col("_v"))).join(base, F.col("uid").eqNullSafe(F.col("_u")), "left")
    at = F.transform(A.running(F.transform("mask", lambda m: (m != 0).cast("int"))), lambda x: (x - 1).cast("int")) if compact else F.transform("mask", lambda _, i: i)
    got = got.withColumn("_tail", F.when((F.col("_len") == F.col("_top")) & (F.col("_tops") == 1), F.get("_second", F.lit(0))))

    def place(x: Column) -> Column:
        kept = F.when(F.col("_rows") == 1, 0.0)
        if zero_tail:
            kept = kept.when(F.col("_tail").isNotNull() & (x["at"] >= F.col("_tail")), 0.0)
        value = (x["ret"] - kept.otherwise(F.get("_b", x["at"]))) * x["m"]
        return F.when(x["m"] != 0, value).otherwise(0.0) if compact else value

    advantage = F.transform(F.arrays_zip(F.col("_ret").alias("ret"), F.col("mask").alias("m"), at.alias("at")), place)
    return got.select(*df.columns, advantage.alias("advantages"), F.col("_ret").alias("returns"))


@register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, zero_tail: bool = False, epsilon: float = 1e-8) -> DataFrame:
    """Returns less a baseline for each group and position.

    The baseline weighs returns by the running sum of 1 - 2 pi + sum of pi squared (times the
    squared importance weight, if the rows have is_weights); groups of one row have none. With
    zero_tail it is 0 from the second longest response's length on for a row that alone is longest.
    """
    return _optimal_baseline(df, zero_tail, False, epsilon)


@register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df: DataFrame, zero_tail: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """As optimal_token_baseline, with positions counted over unmasked tokens only; masked tokens get 0."""
    return _optimal_baseline(df, zero_tail, True, epsilon)


def resample(df: DataFrame, method: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """As many rows as df, drawn with replacement by weights of their scores; `draw` numbers them.

    pow: abs(score) ** power. max_min: 1 for the batch's largest or smallest score, else 0 (equal weights
    where that leaves none). max_random: 0.4 for the largest, 0.1 for others. Draws are seeded
    uniforms, put in order together with the rows' running weights; each takes the row before it.
    """
    scored = _scored(df)
    stats = scored.agg(F.max("_s").alias("_hi"), F.min("_s").alias("_lo"))
    scored = scored.crossJoin(F.broadcast(stats))  # one row
    s = F.col("_s")
    kinds = {"pow": F.pow(F.abs(s), F.lit(power)), "max_min": F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0), "max_random": F.when(s == F.col("_hi"), 0.4).otherwise(0.1)}
    if method not in kinds:
        raise ValueError(f"unknown method {method!r}")
    weighted = scored.select("row_id", kinds[method].alias("w"))
    whole = weighted.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return df.withColumn("draw", F.lit(None).cast("long"))
    if not whole["w"]:
        weighted, whole = weighted.withColumn("w", F.lit(1.0)), {"w": float(whole["n"]), "n": whole["n"]}
    edges = order.prefix_sums(weighted.filter("w > 0"), ["row_id"], F.col("w"), "at").select("at", "row_id", F.lit(None).cast("long").alias("draw"))
    draws = df.sparkSession.range(whole["n"]).select((F.rand(seed) * whole["w"]).alias("at"), F.lit(None).cast("long").alias("row_id"), F.col("id").alias("draw"))
    met = order.carried(edges.unionByName(draws), ["at", F.col("draw").asc_nulls_first()], "row_id", "row_id")
    return met.filter("draw is not null").join(df, "row_id").select(*df.columns, "draw")
