"""Queries of divergences, losses, importance weights and rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import divergence as D
from tallyweave.operators import losses as L
from tallyweave.operators import offpolicy as O
from tallyweave.operators import stats as S
from tallyweave.plans.tables import TOK, query, r6, rollouts, table


def _rows(spark, sf_dir) -> DataFrame:
    """Rollouts with an advantage for each token: its reward less 0.05, times ten."""
    return rollouts(spark, sf_dir).withColumn("advantages", F.transform("rewards", lambda r: (r - 0.05) * 10))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c, c) for c in df.columns])


#: Long form with log-ratio d, clipped log-ratio dc and advantage a.
LT = f"""{TOK}, x AS (SELECT *, lp - olp AS d, greatest(-20, least(20, lp - olp)) AS dc, (r - 0.05::DOUBLE) * 10 AS a FROM tok)"""
#: Row sums of a loss l.
PER = "p AS (SELECT row_id, sum(l * m) AS s, sum(m) AS n FROM l GROUP BY row_id)"
MEAN = "round(sum(l * m) / sum(m), 6) + 0.0"


def _metric(c: str, name: str) -> str:
    return f"round(sum({c} * m) / (sum(m) + 1e-8), 6) + 0.0 AS {name}"


@query("kl_kinds", f"""WITH {TOK}, d AS (SELECT *, olp - ref AS a, greatest(-20, least(20, ref - olp)) AS b FROM tok)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round(a, 6) + 0.0 AS k1, round(abs(a), 6) + 0.0 AS abs, round(0.5 * a * a, 6) + 0.0 AS k2, round(greatest(-10, least(10, exp(b) - b - 1)), 6) + 0.0 AS k3 FROM d""")  # fmt: skip
def kl_kinds(spark, sf_dir):
    made = rollouts(spark, sf_dir)
    for kind in ("k1", "abs", "k2", "k3"):
        made = made.withColumn(kind, D.divergence("old_logp", "ref_logp", kind))
    return S.tokens(made, "k1", "abs", "k2", "k3", keep=("row_id",)).select("row_id", "pos", *[r6(c, c) for c in ("k1", "abs", "k2", "k3")])


@query("token_rewards", f"WITH {TOK} SELECT row_id, CAST(pos AS INTEGER) AS pos, round(r - 0.1::DOUBLE * (olp - ref), 6) + 0.0 AS reward FROM tok")
def token_rewards(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("reward", D.token_rewards("rewards", "old_logp", "ref_logp", 0.1))
    return S.tokens(made, "reward", keep=("row_id",)).select("row_id", "pos", r6("reward", "reward"))


@query("apply_kl_penalty", f"""WITH {TOK}, d AS (SELECT *, greatest(-20, least(20, ref - olp)) AS b FROM tok), k AS (SELECT *, greatest(-10, least(10, exp(b) - b - 1)) * m AS k FROM d)
SELECT row_id, round(sum(r - 0.2::DOUBLE * k), 6) + 0.0 AS reward, round(sum(k) / (sum(m) + 1e-8), 6) + 0.0 AS kl FROM k GROUP BY row_id""")  # fmt: skip
def apply_kl_penalty(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("scores", F.col("rewards"))
    made = D.apply_penalty(made, 0.2, "k3")
    return made.select("row_id", r6(A.array_sum("rewards"), "reward"), r6(A.masked_mean(D.divergence("old_logp", "ref_logp", "k3"), "mask"), "kl"))


@query("batch_kl", f"WITH {TOK}, p AS (SELECT row_id, sum((olp - ref) * m) / (sum(m) + 1e-8) AS k FROM tok GROUP BY row_id) SELECT round(avg(k), 6) AS kl FROM p")
def batch_kl(spark, sf_dir):
    return _rounded(D.batch_divergence(rollouts(spark, sf_dir)))


@query("adaptive_kl_path", """WITH k AS (SELECT event_type AS name, event_id, ln(1 + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, value / 10 - 1)) * 64 / 1000) AS f FROM events WHERE value IS NOT NULL)
SELECT name, row_number() OVER w AS step, round(ln(0.2::DOUBLE) + sum(f) OVER w, 6) + 0.0 AS log_coefficient FROM k WINDOW w AS (PARTITION BY name ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def adaptive_kl_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("name"), "event_id", "value")
    return D.coefficient_rows(e, "value", "name", "event_id", 0.2, 10.0, 1000.0, 64).select("name", "step", r6("log_coefficient", "log_coefficient"))


@query("adaptive_kl_path_all")
def adaptive_kl_path_all(spark, sf_dir):
    """The coefficients themselves, as exponentials of the summed logarithms. They grow large, so sums in another order differ in the last digits shown; tested in Python."""
    return _kl_path(table(spark, sf_dir, "events"))


def _kl_path(events):
    e = events.filter("value is not null").select(F.col("event_type").alias("name"), "event_id", "value")
    path = D.coefficient_rows(e, "value", "name", "event_id", 0.2, 10.0, 1000.0, 64)
    return path.select("name", F.col("step").cast("int").alias("step"), r6(F.exp("log_coefficient"), "coefficient"))


@query("agg_loss_modes", f"""WITH {TOK}, l AS (SELECT *, r - v AS l FROM tok), {PER}
SELECT round(sum(s) / sum(n), 6) AS token_mean, round(sum(CASE WHEN n > 0 THEN s END) / count(*) FILTER (n > 0), 6) AS seq_sum, round(sum(CASE WHEN n > 0 THEN s / (n + 1e-8) END) / count(*) FILTER (n > 0), 6) AS seq_mean, round(sum(s) / 20, 6) AS seq_norm FROM p""")  # fmt: skip
def agg_loss_modes(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("l", F.zip_with("rewards", "values", lambda r, v: r - v))
    modes = {"token_mean": "token-mean", "seq_sum": "seq-mean-token-sum", "seq_mean": "seq-mean-token-mean", "seq_norm": "seq-mean-token-sum-norm"}
    return made.agg(*[r6(L.aggregate_loss("l", "mask", mode, length=20), name) for name, mode in modes.items()])


@query("loss_vanilla", f"""WITH {LT}, q AS (SELECT *, exp(dc) AS ratio, -a * exp(dc) AS l1, -a * greatest(0.9::DOUBLE, least(1.1::DOUBLE, exp(dc))) AS l2, -a * 3 AS l3 FROM x),
l AS (SELECT *, CASE WHEN a < 0 THEN least(l3, greatest(l1, l2)) ELSE greatest(l1, l2) END AS l FROM q)
SELECT {MEAN} AS loss, {_metric('(l2 > l1)::INT', 'clipfrac')}, {_metric('-dc', 'kl')}, {_metric('(greatest(l1, l2) > l3 AND a < 0)::INT', 'clipfrac_lower')} FROM l""")  # fmt: skip
def loss_vanilla(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "vanilla", low=0.1, high=0.1))


@query("loss_gspo", f"""WITH {LT}, s AS (SELECT row_id, exp(least(10, sum(d * m) / greatest(sum(m), 1))) AS ratio FROM x GROUP BY row_id),
l AS (SELECT x.*, -a * ratio AS l1, -a * greatest(0.9::DOUBLE, least(1.1::DOUBLE, ratio)) AS l2, greatest(-a * ratio, -a * greatest(0.9::DOUBLE, least(1.1::DOUBLE, ratio))) AS l FROM x JOIN s USING (row_id)), {PER},
o AS (SELECT {_metric('(l2 > l1)::INT', 'clipfrac')}, {_metric('-d', 'kl')} FROM l)
SELECT round(sum(CASE WHEN n > 0 THEN s / (n + 1e-8) END) / count(*) FILTER (n > 0), 6) + 0.0 AS loss, any_value(clipfrac) AS clipfrac, any_value(kl) AS kl FROM p, o""")  # fmt: skip
def loss_gspo(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "gspo", low=0.1, high=0.1))


@query("loss_sapo", f"""WITH {LT}, q AS (SELECT *, CASE WHEN a > 0 THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END AS tau FROM x),
l AS (SELECT *, -(1 / (1 + exp(-tau * (exp(dc) - 1)))) * (4 / tau) * a AS l FROM q), {PER}, o AS (SELECT {_metric('-dc', 'kl')} FROM l)
SELECT round(sum(CASE WHEN n > 0 THEN s / (n + 1e-8) END) / count(*) FILTER (n > 0), 6) + 0.0 AS loss, any_value(kl) AS kl FROM p, o""")  # fmt: skip
def loss_sapo(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "sapo"))


@query("loss_gpg", f"WITH {LT}, l AS (SELECT *, -lp * a AS l FROM x) SELECT {MEAN} AS loss FROM l")
def loss_gpg(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "gpg"))


@query("loss_cispo", f"""WITH {LT}, q AS (SELECT *, exp(dc) AS ratio, greatest(0.9::DOUBLE, least(1.1::DOUBLE, exp(dc))) AS c FROM x), l AS (SELECT *, -c * a * lp AS l FROM q)
SELECT {MEAN} AS loss, {_metric('(c <> ratio)::INT', 'clipfrac')}, {_metric('-dc', 'kl')} FROM l""")  # fmt: skip
def loss_cispo(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "cispo", low=0.1, high=0.1))


@query("loss_geo_mean", f"""WITH {LT}, q AS (SELECT *, sign(a) * least(sign(a) * d, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, sign(a) * d))) AS b FROM x),
p AS (SELECT row_id, exp(sum(b * m) / (sum(m) + 1e-8)) AS ratio, sum(a * m) / (sum(m) + 1e-8) AS a FROM q GROUP BY row_id) SELECT round(avg(-ratio * a), 6) + 0.0 AS loss FROM p""")  # fmt: skip
def loss_geo_mean(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "geo_mean", low=0.1, high=0.1))


@query("loss_kl_cov", f"""WITH {LT}, t AS (SELECT * FROM x WHERE m = 1), mm AS (SELECT avg(a) AS ma, avg(lp) AS mp, count(*) AS n FROM t),
k AS (SELECT t.*, row_number() OVER (ORDER BY round((a - ma) * (lp - mp), 9) DESC, row_id, pos) AS k, n FROM t, mm),
l AS (SELECT -a * exp(d) + CASE WHEN k <= greatest(1, floor(n * 0.01::DOUBLE)) THEN 0.5 * abs(d) ELSE 0 END AS l, abs(d) AS g FROM k) SELECT round(avg(l), 6) + 0.0 AS loss, round(avg(g), 6) AS kl_abs FROM l""")  # fmt: skip
def loss_kl_cov(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "kl_cov", share=0.01, coefficient=0.5))


@query("loss_clip_cov")
def loss_clip_cov(spark, sf_dir):
    """Which tokens go is decided by a hash that SQL here lacks; tested by invariants."""
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "clip_cov", ratio=0.001, lower=0.02, upper=5.0))


@query("loss_reinforce", f"WITH {LT}, l AS (SELECT *, -lp * a AS l FROM x), {PER} SELECT round(sum(CASE WHEN n > 0 THEN s END) / count(*) FILTER (n > 0), 6) + 0.0 AS loss FROM p")
def loss_reinforce(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "reinforce"))


#: Off-policy long form: weight of a token and log-ratio of two policies.
OFF = f"""{TOK}, x AS (SELECT *, olp - rlp AS lr, greatest(-20, least(20, olp - rlp)) AS lrc, (r - 0.05::DOUBLE) * 10 AS a, lp - rlp AS bypass FROM tok)"""


@query("loss_bypass_mode", f"""WITH {OFF}, w AS (SELECT *, least(exp(greatest(-20, least(20, bypass))) * m, 1.1::DOUBLE) AS w, CASE WHEN -bypass BETWEEN ln(0.8::DOUBLE) AND ln(1.25::DOUBLE) THEN m ELSE 0 END AS mm FROM x),
p AS (SELECT row_id, sum(-lp * a * w * mm) AS s, sum(mm) AS n FROM w GROUP BY row_id) SELECT round(sum(CASE WHEN n > 0 THEN s END) / count(*) FILTER (n > 0), 6) + 0.0 AS loss FROM p""")  # fmt: skip
def loss_bypass_mode(spark, sf_dir):
    return _rounded(L.policy_loss(_rows(spark, sf_dir), "bypass_mode", level="token", threshold=1.1, options="token_k1", thresholds="0.8_1.25"))


@query("value_loss", f"""WITH {TOK}, q AS (SELECT *, greatest(v - 0.02::DOUBLE, least(v + 0.02::DOUBLE, r)) AS c, r + v AS ret FROM tok),
l AS (SELECT *, greatest((r - ret) ** 2, (c - ret) ** 2) AS l, ((c - ret) ** 2 > (r - ret) ** 2)::INT AS f FROM q) SELECT round(0.5 * sum(l * m) / sum(m), 6) AS loss, {_metric('f', 'clipfrac')} FROM l""")  # fmt: skip
def value_loss(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("vpreds", F.col("rewards")).withColumn("returns", F.zip_with("rewards", "values", lambda r, v: r + v))
    return _rounded(L.value_loss(made, clip_range=0.02))


@query("entropy_loss", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), l AS (SELECT vec_id, ln(sum(exp(x))) AS lse FROM e GROUP BY vec_id),
h AS (SELECT vec_id, any_value(lse) - sum(exp(x - lse) * x) AS h FROM e JOIN l USING (vec_id) GROUP BY vec_id) SELECT round(avg(h), 6) AS entropy FROM h WHERE vec_id % 3 <> 0""")  # fmt: skip
def entropy_loss(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.array("embedding").alias("logits"), F.array(F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0)).alias("mask"))
    return _rounded(L.entropy_loss(e))


@query("sft_loss", f"WITH {TOK} SELECT round(-sum(lp * m) / sum(m), 6) AS loss FROM tok")
def sft_loss(spark, sf_dir):
    return _rounded(L.sft_loss(rollouts(spark, sf_dir)))


@query("ppo_loss", f"""WITH {LT}, q AS (SELECT *, greatest(-20, least(20, ref - lp)) AS b, CASE WHEN a < 0 THEN least(-a * 3, greatest(-a * exp(dc), -a * greatest(0.8::DOUBLE, least(1.2::DOUBLE, exp(dc))))) ELSE greatest(-a * exp(dc), -a * greatest(0.8::DOUBLE, least(1.2::DOUBLE, exp(dc)))) END AS l FROM x),
o AS (SELECT sum(l * m) / sum(m) AS policy, sum(v * m) / sum(m) AS entropy, sum(greatest(-10, least(10, exp(b) - b - 1)) * m) / sum(m) AS kl FROM q)
SELECT round(policy - 0.01::DOUBLE * entropy + 0.1::DOUBLE * kl, 6) + 0.0 AS loss, round(policy, 6) + 0.0 AS policy, round(entropy, 6) AS entropy, round(kl, 6) AS kl FROM o""")  # fmt: skip
def ppo_loss(spark, sf_dir):
    made = _rows(spark, sf_dir).withColumn("entropy", F.col("values"))
    return _rounded(L.ppo_loss(made, entropy_weight=0.01, kl_weight=0.1))


@query("is_weights_token", f"WITH {OFF} SELECT row_id, CAST(pos AS INTEGER) AS pos, round(least(exp(lrc) * m, 1.1::DOUBLE), 6) + 0.0 AS w FROM x")
def is_weights_token(spark, sf_dir):
    made = O.importance_weights(rollouts(spark, sf_dir), "token", 1.1)
    return S.tokens(made, "is_weights", keep=("row_id",)).select("row_id", "pos", r6("is_weights", "w"))


@query("is_weights_sequence", f"""WITH {OFF}, s AS (SELECT row_id, exp(greatest(-20, least(20, sum(lr * m)))) AS w FROM x GROUP BY row_id)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round(least(w * m, 2.0::DOUBLE), 6) + 0.0 AS w FROM x JOIN s USING (row_id)""")  # fmt: skip
def is_weights_sequence(spark, sf_dir):
    made = O.importance_weights(rollouts(spark, sf_dir), "sequence", 2.0)
    return S.tokens(made, "is_weights", keep=("row_id",)).select("row_id", "pos", r6("is_weights", "w"))


@query("is_weights_normalized", f"""WITH {OFF}, w AS (SELECT *, least(exp(lrc) * m, 1.1::DOUBLE) AS w FROM x), k AS (SELECT sum(w * m) / sum(m) AS k FROM w)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round(w / k, 6) + 0.0 AS w FROM w, k""")  # fmt: skip
def is_weights_normalized(spark, sf_dir):
    made = O.importance_weights(rollouts(spark, sf_dir), "token", 1.1, normalize=True)
    return S.tokens(made, "is_weights", keep=("row_id",)).select("row_id", "pos", r6("is_weights", "w"))


#: Option, threshold and the SQL of what it keeps.
_STAT = {"k1": "-lrc", "k2": "0.5 * lrc * lrc", "k3": "exp(lrc) - 1 - lrc"}
REJECT = {
    "token_k1": "0.9_1.1", "token_k2": "0.00507", "token_k3": "0.00507", "seq_sum_k1": "0.8_1.25", "seq_sum_k2": "0.02013", "seq_sum_k3": "0.02013",
    "seq_mean_k1": "0.95_1.05", "seq_mean_k2": "0.00507", "seq_mean_k3": "0.00507", "seq_max_k2": "0.01013", "seq_max_k3": "0.01013",
}


def _reject_sql(option: str, spec: str) -> str:
    level, kind = option.rsplit("_", 1)
    parts = spec.split("_")
    inside = (lambda s: f"{s} BETWEEN ln({parts[0]}::DOUBLE) AND ln({parts[1]}::DOUBLE)") if kind == "k1" else (lambda s: f"{s} <= {spec}::DOUBLE")
    if level == "token":
        return f"WITH {OFF} SELECT row_id, CAST(sum(CASE WHEN {inside(_STAT[kind])} THEN m ELSE 0 END) AS BIGINT) AS kept FROM x GROUP BY row_id"
    value = {"seq_sum": f"sum(({_STAT[kind]}) * m)", "seq_mean": f"sum(({_STAT[kind]}) * m) / greatest(sum(m), 1)", "seq_max": f"max(({_STAT[kind]}) * m)"}[level]
    return f"WITH {OFF}, s AS (SELECT row_id, sum(m) AS n, {value} AS s FROM x GROUP BY row_id) SELECT row_id, CAST(CASE WHEN {inside('s')} THEN n ELSE 0 END AS BIGINT) AS kept FROM s"


def _rejecter(option: str, spec: str):
    def run(spark, sf_dir):
        made = O.rejection_mask(rollouts(spark, sf_dir), option, spec)
        return made.select("row_id", A.array_sum("mask").cast("long").alias("kept"))

    return run


for _option, _spec in REJECT.items():
    query(f"reject_{_option}", _reject_sql(_option, _spec))(_rejecter(_option, _spec))


@query("is_metrics", f"""WITH {OFF}, w AS (SELECT exp(lrc) AS w, greatest(1 / 1.1::DOUBLE, least(1.1::DOUBLE, exp(lrc))) AS c FROM x WHERE m = 1)
SELECT round(avg(w), 6) AS is_mean, round(max(w), 6) AS is_max, round(min(w), 6) AS is_min, round(sqrt(greatest(avg(c * c) - avg(c) ** 2, 0)), 6) AS is_std, round(avg((w > 1.1::DOUBLE)::INT), 6) AS is_fraction_high, round(avg((w < 1 / 1.1::DOUBLE)::INT), 6) AS is_fraction_low, round(avg(c) ** 2 / avg(c * c), 6) AS is_ess FROM w""")  # fmt: skip
def is_metrics(spark, sf_dir):
    return _rounded(O.weight_metrics(rollouts(spark, sf_dir), "token", 1.1))


@query("rs_metrics", f"""WITH {OFF}, s AS (SELECT sum((0.5 * lrc * lrc) * m) AS s FROM x GROUP BY row_id HAVING sum(m) > 0), c AS (SELECT s, least(s, 0.02013::DOUBLE) AS c FROM s)
SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(min(s), 6) AS min, round(sqrt(greatest(avg(c * c) - avg(c) ** 2, 0)), 6) AS std, round(avg((s > 0.02013::DOUBLE)::INT), 6) AS fraction_high, 0.0::DOUBLE AS fraction_low FROM c""")  # fmt: skip
def rs_metrics(spark, sf_dir):
    return _rounded(O.rejection_metrics(rollouts(spark, sf_dir), "seq_sum_k2", 0.02013))


@query("offpolicy_metrics", f"""WITH {OFF}, p AS (SELECT row_id, sum(olp * m) / sum(m) AS o, sum(rlp * m) / sum(m) AS r, exp(greatest(-20, least(20, sum(lr * m)))) AS w FROM x GROUP BY row_id HAVING sum(m) > 0),
t AS (SELECT -avg(lr) AS kl, avg(exp(lr) - lr - 1) AS k3_kl, avg(exp(2 * lrc)) - 1 AS chi2_token FROM x WHERE m = 1)
SELECT round(avg(exp(-o)), 6) AS training_ppl, round(avg(-o), 6) AS training_log_ppl, round(any_value(kl), 6) + 0.0 AS kl, round(avg(exp(-r)), 6) AS rollout_ppl, round(avg(-r), 6) AS rollout_log_ppl, round(avg(r - o), 6) + 0.0 AS log_ppl_diff, round(avg(abs(r - o)), 6) AS log_ppl_abs_diff,
round(max(r - o), 6) AS log_ppl_diff_max, round(min(r - o), 6) AS log_ppl_diff_min, round(avg(exp(r - o)), 6) AS ppl_ratio, round(any_value(k3_kl), 6) AS k3_kl, round(any_value(chi2_token), 6) AS chi2_token, round(avg(w * w) - 1, 6) AS chi2_seq FROM p, t""")  # fmt: skip
def offpolicy_metrics(spark, sf_dir):
    return _rounded(O.offpolicy_metrics(rollouts(spark, sf_dir)))
