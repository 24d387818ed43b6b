"""Queries of statistics and advantage estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import advantages as V
from tallyweave.operators import stats as S
from tallyweave.operators import verbs
from tallyweave.plans.tables import GRP, TOK, query, r6, rollouts, table


def _long(df: DataFrame) -> DataFrame:
    """(row_id, pos, advantages, returns), rounded."""
    return S.tokens(df, "advantages", "returns", keep=("row_id",)).select("row_id", "pos", r6("advantages", "advantages"), r6("returns", "returns"))


def _outcome(value: str, where: str = "") -> str:
    """SQL of an estimator that gives every token of a row one value, masked."""
    return f"WITH {GRP} SELECT t.row_id, CAST(pos AS INTEGER) AS pos, round(({value}) * m, 6) + 0.0 AS advantages, round(({value}) * m, 6) + 0.0 AS returns FROM tok t JOIN g USING (row_id) {where}"


@query("flagship_grpo_by_segment", f"""WITH {GRP}, a AS (SELECT data_source, (s - CASE WHEN c = 1 THEN 0 ELSE mu END) / (CASE WHEN c = 1 THEN 1 ELSE sd END + 1e-6) AS a, s FROM g)
SELECT data_source, count(*) AS responses, round(avg(s), 6) + 0.0 AS score_mean, round(avg(a), 6) + 0.0 AS advantage_mean, round(stddev_samp(a), 6) + 0.0 AS advantage_std, round(min(a), 6) + 0.0 AS advantage_min, round(max(a), 6) + 0.0 AS advantage_max FROM a GROUP BY data_source""")  # fmt: skip
def flagship(spark, sf_dir):
    scored = rollouts(spark, sf_dir, "rewards").select("row_id", "uid", "data_source", A.array_sum("rewards").alias("s"))
    g = S.group_stats(F.col("s"), "uid")
    one = g["n"] == 1
    made = scored.withColumn("a", (F.col("s") - F.when(one, 0.0).otherwise(g["mean"])) / (F.when(one, 1.0).otherwise(g["std"]) + 1e-6))
    return made.groupBy("data_source").agg(F.count("*").alias("responses"), r6(F.avg("s"), "score_mean"), r6(F.avg("a"), "advantage_mean"), r6(F.stddev_samp("a"), "advantage_std"), r6(F.min("a"), "advantage_min"), r6(F.max("a"), "advantage_max"))


@query("masked_mean_rows", f"WITH {TOK} SELECT row_id, round(sum(r * m), 6) + 0.0 AS total, round(sum(r * m) / (sum(m) + 1e-8), 6) + 0.0 AS mean FROM tok GROUP BY row_id")
def masked_mean_rows(spark, sf_dir):
    return rollouts(spark, sf_dir, "rewards", "mask").select("row_id", r6(A.masked_sum("rewards", "mask"), "total"), r6(A.masked_mean("rewards", "mask"), "mean"))


@query("masked_moments", f"WITH {TOK} SELECT CAST(sum(m) AS DOUBLE) AS n, round(sum(r * m), 6) AS total, round(avg(r) FILTER (m = 1), 6) AS mean, round(var_samp(r) FILTER (m = 1), 6) AS var FROM tok")
def masked_moments(spark, sf_dir):
    return S.masked_moments(rollouts(spark, sf_dir, "rewards", "mask"), "rewards", "mask").select("n", r6("sum", "total"), r6("mean", "mean"), r6("var", "var"))


def _whiten_sql(shift: str) -> str:
    return f"WITH {TOK}, mv AS (SELECT avg(r) FILTER (m = 1) AS mu, var_samp(r) FILTER (m = 1) AS va FROM tok) SELECT row_id, CAST(pos AS INTEGER) AS pos, round((r - mu) / sqrt(va + 1e-8){shift}, 6) + 0.0 AS white FROM tok, mv"


@query("masked_whiten", _whiten_sql(""))
def masked_whiten(spark, sf_dir):
    made = S.whiten(rollouts(spark, sf_dir, "rewards", "mask"), "rewards", "mask", "white")
    return S.tokens(made, "white", keep=("row_id",)).select("row_id", "pos", r6("white", "white"))


@query("masked_whiten_keep_mean", _whiten_sql(" + mu"))
def masked_whiten_keep_mean(spark, sf_dir):
    made = S.whiten(rollouts(spark, sf_dir, "rewards", "mask"), "rewards", "mask", "white", shift_mean=False)
    return S.tokens(made, "white", keep=("row_id",)).select("row_id", "pos", r6("white", "white"))


@query("group_mean_std", f"WITH {GRP} SELECT uid, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(s) END, 6) + 0.0 AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(s), 1e-6)) END, 6) + 0.0 AS std FROM s GROUP BY uid")
def group_mean_std(spark, sf_dir):
    scored = rollouts(spark, sf_dir, "rewards").select("uid", A.array_sum("rewards").alias("s"))
    return S.group_mean_std(scored, "s", "uid").select("uid", "n", r6("mean", "mean"), r6("std", "std"))


@query("masked_mean_exact", f"WITH {TOK} SELECT round(sum(r * m) / sum(m), 6) AS mean FROM tok")
def masked_mean_exact(spark, sf_dir):
    return S.masked_mean_exact(rollouts(spark, sf_dir, "rewards", "mask"), "rewards", "mask").select(r6("mean", "mean"))


@query("mean_max_min_std", f"WITH {GRP} SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(min(s), 6) AS min, round(stddev_samp(s), 6) AS std FROM s")
def mean_max_min_std(spark, sf_dir):
    scored = rollouts(spark, sf_dir, "rewards").select(A.array_sum("rewards").alias("s"))
    return S.mean_max_min_std(scored, "s").select(*[r6(c, c) for c in ("mean", "max", "min", "std")])


@query("adv_grpo", _outcome("(s - CASE WHEN c = 1 THEN 0 ELSE mu END) / (CASE WHEN c = 1 THEN 1 ELSE sd END + 1e-6)"))
def adv_grpo(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "grpo"))


@query("adv_grpo_without_std", _outcome("s - CASE WHEN c = 1 THEN 0 ELSE mu END"))
def adv_grpo_without_std(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "grpo", by_std=False))


@query("adv_grpo_vectorized", _outcome("(s - CASE WHEN c = 1 THEN 0 ELSE mu END) / (CASE WHEN c = 1 THEN 1 ELSE sqrt(greatest(sd * sd, 1e-6)) END + 1e-6)"))
def adv_grpo_vectorized(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "grpo_vectorized"))


@query("adv_grpo_passk", f"""WITH {GRP}, k AS (SELECT *, row_number() OVER o AS k, s - lead(s) OVER o AS d FROM g WHERE c > 1 WINDOW o AS (PARTITION BY uid ORDER BY round(s, 9) DESC, row_id))
SELECT t.row_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN k = 1 THEN d / (sd + 1e-6) ELSE 0 END * m, 6) + 0.0 AS advantages, round(CASE WHEN k = 1 THEN d / (sd + 1e-6) ELSE 0 END * m, 6) + 0.0 AS returns FROM tok t JOIN k USING (row_id)""")  # fmt: skip
def adv_grpo_passk(spark, sf_dir):
    from pyspark.sql import Window

    made = rollouts(spark, sf_dir, "rewards", "mask").withColumn("_n", F.count("*").over(Window.partitionBy("uid"))).filter("_n > 1").drop("_n")
    return _long(V.advantages(made, "grpo_passk"))


@query("adv_rloo", _outcome("CASE WHEN c > 1 THEN (s - mu) * c / (c - 1) ELSE s END"))
def adv_rloo(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "rloo"))


@query("adv_rloo_vectorized", _outcome("(c * s - ss) / greatest(c - 1, 1)"))
def adv_rloo_vectorized(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "rloo_vectorized"))


@query("adv_opo", f"""WITH {GRP}, o AS (SELECT *, sum(n * s) OVER w / sum(n) OVER w AS b FROM g WINDOW w AS (PARTITION BY uid))
SELECT t.row_id, CAST(pos AS INTEGER) AS pos, round((s - CASE WHEN c = 1 THEN 0 ELSE b END) * m + 1e-9, 6) + 0.0 AS advantages, round((s - CASE WHEN c = 1 THEN 0 ELSE b END) * m + 1e-9, 6) + 0.0 AS returns FROM tok t JOIN o USING (row_id)""")  # fmt: skip
def adv_opo(spark, sf_dir):
    made = V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "opo")
    up = lambda c: F.transform(c, lambda x: x + 1e-9)  # noqa: E731  weighted means often end in a 5
    return _long(made.withColumn("advantages", up("advantages")).withColumn("returns", up("returns")))


@query("adv_gpg", f"""WITH {GRP}, k AS (SELECT count(*) / greatest(count(*) FILTER (s <> 0), 1) AS alpha FROM s)
SELECT t.row_id, CAST(pos AS INTEGER) AS pos, round(alpha * (s - CASE WHEN c = 1 THEN 0 ELSE mu END) * m, 6) + 0.0 AS advantages, round(alpha * (s - CASE WHEN c = 1 THEN 0 ELSE mu END) * m, 6) + 0.0 AS returns FROM tok t JOIN g USING (row_id), k""")  # fmt: skip
def adv_gpg(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "gpg"))


@query("adv_reinforce_plus_plus_baseline", f"""WITH {GRP}, a AS (SELECT t.row_id, pos, m, (s - CASE WHEN c = 1 THEN 0 ELSE mu END) * m AS a FROM tok t JOIN g USING (row_id)),
mv AS (SELECT avg(a) FILTER (m = 1) AS mu, var_samp(a) FILTER (m = 1) AS va FROM a)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round((a - mu) / sqrt(va + 1e-8) * m, 6) + 0.0 AS advantages, round((a - mu) / sqrt(va + 1e-8) * m, 6) + 0.0 AS returns FROM a, mv""")  # fmt: skip
def adv_reinforce_plus_plus_baseline(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "reinforce_plus_plus_baseline"))


@query("adv_reinforce_plus_plus", f"""WITH RECURSIVE {TOK}, back AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos DESC) AS k FROM tok),
f AS (SELECT row_id, pos, k, m, r AS g, r * m AS carry FROM back WHERE k = 1
  UNION ALL SELECT b.row_id, b.pos, b.k, b.m, b.r + 0.9::DOUBLE * f.carry, (b.r + 0.9::DOUBLE * f.carry) * b.m FROM f JOIN back b ON b.row_id = f.row_id AND b.k = f.k + 1),
mv AS (SELECT avg(g) FILTER (m = 1) AS mu, var_samp(g) FILTER (m = 1) AS va FROM f)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round((g - mu) / sqrt(va + 1e-8) * m, 6) + 0.0 AS advantages, round(g, 6) + 0.0 AS returns FROM f, mv""")  # fmt: skip
def adv_reinforce_plus_plus(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask"), "reinforce_plus_plus", gamma=0.9))


@query("adv_gae", f"""WITH RECURSIVE {TOK}, back AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos DESC) AS k FROM tok),
f AS (SELECT row_id, pos, k, m, v, CASE WHEN m = 1 THEN r - v ELSE 0 END AS a, CASE WHEN m = 1 THEN v ELSE 0 END AS nv FROM back WHERE k = 1
  UNION ALL SELECT b.row_id, b.pos, b.k, b.m, b.v, CASE WHEN b.m = 1 THEN b.r + 0.99::DOUBLE * f.nv - b.v + 0.99::DOUBLE * 0.95::DOUBLE * f.a ELSE f.a END, CASE WHEN b.m = 1 THEN b.v ELSE f.nv END
  FROM f JOIN back b ON b.row_id = f.row_id AND b.k = f.k + 1),
mv AS (SELECT avg(a) FILTER (m = 1) AS mu, var_samp(a) FILTER (m = 1) AS va FROM f)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round((a - mu) / sqrt(va + 1e-8), 6) + 0.0 AS advantages, round(a + v, 6) + 0.0 AS returns FROM f, mv""")  # fmt: skip
def adv_gae(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask", "values"), "gae", gamma=0.99, lam=0.95))


@query("adv_remax", f"""WITH {TOK}, f AS (SELECT row_id, pos, m, sum(r * m) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM tok)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round(g - 0.1 * m, 6) + 0.0 AS advantages, round(g, 6) + 0.0 AS returns FROM f""")  # fmt: skip
def adv_remax(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask").withColumn("reward_baselines", F.lit(0.1)), "remax"))


def _otb_sql(compact: bool, zero_tail: bool) -> str:
    at = "row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1" if compact else "pos"
    used = "WHERE m = 1" if compact else ""
    tail = "WHEN tail IS NOT NULL AND place >= tail THEN 0" if zero_tail else ""
    return f"""WITH {TOK}, ret AS (SELECT *, sum(r * m) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tok),
u AS (SELECT *, {at} AS place, sum((1 - 2 * exp(olp) + spi) * m) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM ret {used}),
b AS (SELECT *, sum(ret * w * m) OVER p / (sum(w * m) OVER p + 1e-8) AS b FROM u WINDOW p AS (PARTITION BY uid, place)),
l AS (SELECT row_id, uid, sum(m) AS len FROM tok GROUP BY row_id, uid),
k AS (SELECT *, count(*) OVER (PARTITION BY uid) AS rows, row_number() OVER o AS nth, lead(len) OVER o AS second FROM l WINDOW o AS (PARTITION BY uid ORDER BY len DESC)),
kt AS (SELECT row_id, rows, CASE WHEN nth = 1 AND len > second THEN second END AS tail FROM k),
a AS (SELECT row_id, pos, (ret - CASE WHEN rows = 1 THEN 0 {tail} ELSE b END) * m AS a FROM b JOIN kt USING (row_id))
SELECT ret.row_id, CAST(ret.pos AS INTEGER) AS pos, round(coalesce(a, 0), 6) + 0.0 AS advantages, round(ret, 6) + 0.0 AS returns FROM ret LEFT JOIN a USING (row_id, pos)"""


@query("adv_optimal_token_baseline", _otb_sql(False, False))
def adv_optimal_token_baseline(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask", "old_logp", "sum_pi_sq"), "optimal_token_baseline"))


@query("adv_tir_optimal_token_baseline", _otb_sql(True, True))
def adv_tir_optimal_token_baseline(spark, sf_dir):
    return _long(V.advantages(rollouts(spark, sf_dir, "rewards", "mask", "old_logp", "sum_pi_sq"), "tir_optimal_token_baseline"))


@query("resample_by_score")
def resample_by_score(spark, sf_dir):
    """As many rows as there are, by squared scores; tested by invariants."""
    made = V.resample(rollouts(spark, sf_dir), "pow", 2.0, seed=7)
    return made.select("draw", "row_id", r6(A.array_sum("rewards"), "score"))


@query("first_end_mask", f"""WITH {TOK}, e AS (SELECT row_id, min(pos) FILTER (m = 0) AS e FROM tok GROUP BY row_id)
SELECT row_id, CAST(pos AS INTEGER) AS pos, CASE WHEN e IS NULL OR pos <= e THEN 1 ELSE 0 END AS keep FROM tok JOIN e USING (row_id)""")  # fmt: skip
def first_end_mask(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("keep", A.first_end_mask("mask", F.lit(0)))
    return S.tokens(made, "keep", keep=("row_id",))


@query("position_ids", f"WITH {TOK} SELECT row_id, CAST(pos AS INTEGER) AS pos, CAST(greatest(sum(m) OVER (PARTITION BY row_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1, 0) AS INTEGER) AS position_id FROM tok")
def position_ids(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("position_id", A.positions("mask"))
    return S.tokens(made, "position_id", keep=("row_id",))


@query("run_positions", """WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders),
n AS (SELECT *, CASE WHEN o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER (ORDER BY row_id) OR row_id = 0 THEN 1 ELSE 0 END AS new FROM o),
s AS (SELECT *, sum(new) OVER (ORDER BY row_id) AS run FROM n)
SELECT o_orderkey, row_number() OVER (PARTITION BY run ORDER BY row_id) - 1 AS run_pos FROM s""")  # fmt: skip
def run_positions(spark, sf_dir):
    orders = verbs.with_row_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return verbs.run_positions(orders, "o_orderpriority").select("o_orderkey", "run_pos")


@query("logit_statistics", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), t AS (SELECT vec_id, max(x) AS top FROM e GROUP BY vec_id),
l AS (SELECT vec_id, any_value(top) + ln(sum(exp(x - top))) AS lse FROM e JOIN t USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(any_value(lse) - sum(exp(x - lse) * x), 6) AS entropy, round(sum(exp(x - lse) ** 2), 6) AS sum_pi_squared, round(any_value(f) - any_value(lse), 6) AS logp
FROM e JOIN l USING (vec_id) JOIN (SELECT vec_id, embedding[label + 1]::DOUBLE AS f FROM embeddings) USING (vec_id) GROUP BY vec_id""")  # fmt: skip
def logit_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", r6(A.entropy("embedding"), "entropy"), r6(A.sum_pi_squared("embedding"), "sum_pi_squared"), r6(A.log_prob("embedding", "label"), "logp"))
