"""Estimators, losses, metrics, rollups, balancing and verbs on worked examples and invariants."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import advantages as V
from tallyweave.operators import balance as B
from tallyweave.operators import divergence as D
from tallyweave.operators import evaluation as E
from tallyweave.operators import losses as L
from tallyweave.operators import metrics as M
from tallyweave.operators import offpolicy as O
from tallyweave.operators import stats as S
from tallyweave.operators import verbs
from tallyweave.plans import batch_queries, loss_queries, more_queries, scoring_queries

ROW = "row_id long, uid string, rewards array<double>, mask array<int>"


def one(df):
    return df.first().asDict()


def test_masked_mean_ignores_nan_under_the_mask(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 1, 0])], "v array<double>, m array<int>")
    a, b, c = [r[0] for r in df.select(A.masked_mean("v", "m")).collect()]
    assert a == b == pytest.approx(2.5) and np.isnan(c)


@pytest.mark.parametrize("seed", [0, 1])
def test_gae_does_not_see_masked_values(spark, seed):
    rewards, mask = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rng = np.random.default_rng(seed)
    gamma, lam = float(rng.random()), float(rng.random())

    def run(fill):
        values = [float(x) for x in fill]
        for i, v in zip([i for i, m in enumerate(mask) if m], [4.0, 5.0, 6.0, 7.0, 9.0], strict=True):
            values[i] = v
        df = spark.createDataFrame([(0, "a", rewards, mask, values)], f"{ROW}, values array<double>")
        r = one(V.advantages(df, "gae", gamma=gamma, lam=lam))
        return np.array(r["advantages"]), np.array(r["returns"]) * mask

    (a, x), (b, y) = run(rng.random(11)), run(rng.random(11))
    assert np.allclose(a, b) and np.allclose(x, y)


def test_group_relative_examples(spark):
    df = spark.createDataFrame([(0, "a", [1.0], [1]), (1, "a", [0.0], [1]), (2, "b", [1.0, 2.0], [1, 1])], ROW)
    get = lambda name, **kw: {r["row_id"]: r["advantages"][0] for r in V.advantages(df, name, **kw).collect()}
    std = 0.5**0.5
    assert get("grpo") == pytest.approx({0: 0.5 / (std + 1e-6), 1: -0.5 / (std + 1e-6), 2: 3 / (1 + 1e-6)})
    assert get("rloo") == pytest.approx({0: 1.0, 1: -1.0, 2: 3.0})
    assert get("rloo_vectorized") == pytest.approx({0: 1.0, 1: -1.0, 2: 0.0})
    assert get("opo")[2] == pytest.approx(3.0) and get("gpg")[2] == pytest.approx(3.0 * 3 / 2)
    with pytest.raises(PySparkException):
        get("grpo_passk")
    with pytest.raises(ValueError):
        V.advantages(df, "nothing")


@pytest.mark.parametrize("shape", [(64, 24, 5), (128, 12, 8)])
def test_two_forms_agree_and_shifts_cancel(spark, shape):
    rows, length, groups = shape
    rng = np.random.default_rng(rows)
    data = [(i, str(i % groups), rng.random(length).tolist(), rng.integers(0, 2, length).tolist()) for i in range(rows)]
    df = spark.createDataFrame(data, ROW)
    table = lambda d, name: np.array([r["advantages"] for r in V.advantages(d, name).orderBy("row_id").collect()])
    assert np.allclose(table(df, "grpo"), table(df, "grpo_vectorized"), rtol=1e-5, atol=1e-6)
    assert np.allclose(table(df, "rloo"), table(df, "rloo_vectorized"), rtol=1e-5, atol=1e-6)
    moved = df.withColumn("rewards", F.transform("rewards", lambda x, i: F.when(i == 0, x + F.col("uid").cast("double")).otherwise(x)))
    assert np.allclose(table(df, "grpo"), table(moved, "grpo"), atol=1e-6)
    assert np.allclose(table(df.repartition(7), "rloo"), table(df, "rloo"))


def test_passk_ties_go_to_the_smaller_row(spark):
    df = spark.createDataFrame([(0, "a", [1.0], [1]), (1, "a", [3.0], [1]), (2, "a", [3.0], [1]), (3, "b", [2.0], [1]), (4, "b", [5.0], [1])], ROW)
    got = {r["row_id"]: r["advantages"][0] for r in V.advantages(df, "grpo_passk", by_std=False).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 3.0}


def test_optimal_baseline_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(12):
        n = int(rng.integers(3, 9))
        data.append((i, "abc"[i % 3] if i < 11 else "d", rng.random(n).tolist(), [1] * n, (-rng.random(n)).tolist(), rng.random(n).tolist()))
    df = spark.createDataFrame(data, f"{ROW}, old_logp array<double>, sum_pi_sq array<double>")
    got = {r["row_id"]: r for r in V.advantages(df, "optimal_token_baseline").collect()}
    for i, uid, r, m, logp, sq in data:
        ret = np.cumsum(np.array(r)[::-1])[::-1]
        mates = [d for d in data if d[1] == uid]
        for t in range(len(r)):
            top = low = 0.0
            for _, _, r2, _, l2, s2 in mates:
                if t < len(r2):
                    w = np.cumsum(1 - 2 * np.exp(l2) + s2)[t]
                    top += np.cumsum(np.array(r2)[::-1])[::-1][t] * w
                    low += w
            base = top / (low + 1e-8) if len(mates) > 1 else 0.0
            assert got[i]["advantages"][t] == pytest.approx(ret[t] - base)


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(i, "a", [float(i % 2) * 2], [1]) for i in range(400)], ROW)
    got = V.resample(df, "pow", 2.0, seed=1).collect()
    assert len(got) == 400 and sorted(r["draw"] for r in got) == list(range(400)) and all(r["row_id"] % 2 for r in got)
    assert V.resample(df.limit(0)).count() == 0


def test_divergences_and_coefficient(spark):
    df = spark.createDataFrame([([0.0, -1.0], [-0.5, -0.5])], "a array<double>, b array<double>")
    k = lambda kind: df.select(D.divergence("a", "b", kind)).first()[0]
    assert k("kl") == [0.5, -0.5] and k("abs") == [0.5, 0.5] and k("k2") == [0.125, 0.125]
    assert k("k3") == pytest.approx([np.exp(-0.5) + 0.5 - 1, np.exp(0.5) - 0.5 - 1]) and k("k3+") == k("k3")
    with pytest.raises(ValueError):
        k("full")
    c = D.Coefficient(0.2, target=6.0, horizon=100)
    assert c.update(60.0, 10) == pytest.approx(0.2 * 1.02) and D.Coefficient(0.3).update(9.0, 10) == 0.3


def test_thresholds():
    assert O.parse_thresholds(["token_k1"], "2.0") == [(0.5, 2.0)]
    assert O.parse_thresholds(["token_k1", "seq_max_k2"], "0.5_1.5,3") == [(0.5, 1.5), (None, 3.0)]
    for options, spec in ((["token_k2"], "0.5_1.5"), (["nope"], "1"), (["token_k1"], "1,2"), (["token_k1"], "-1")):
        with pytest.raises(ValueError):
            O.parse_thresholds(options, spec)


@pytest.mark.parametrize("option", O.OPTIONS)
def test_rejection_only_removes(spark, option):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(-1, 0.3, 10).tolist(), rng.normal(-1, 0.3, 10).tolist(), [1] * 10) for i in range(4)], "row_id long, old_logp array<double>, rollout_logp array<double>, mask array<int>")
    spec = "0.9_1.1" if option.endswith("k1") else "0.05"
    for r in O.correct(df, "token", 2.0, options=option, thresholds=spec).collect():
        assert max(r["is_weights"]) <= 2.0 and set(r["mask"]) <= {0, 1}
        assert option.startswith("token") or len(set(r["mask"])) == 1


def test_losses_run_and_agree_at_ratio_one(spark):
    data = [(0, [-1.0, -2.0], [1.0, -1.0], [1, 1]), (1, [-0.5], [2.0], [1]), (2, [-0.1], [9.0], [0])]
    df = spark.createDataFrame(data, "row_id long, logp array<double>, advantages array<double>, mask array<int>").withColumn("old_logp", F.col("logp")).withColumn("rollout_logp", F.col("logp"))
    assert one(L.policy_loss(df, "vanilla"))["loss"] == pytest.approx(-2 / 3)
    assert one(L.policy_loss(df, "gspo"))["loss"] == pytest.approx((0.0 - 2.0) / 2)
    assert one(L.policy_loss(df, "gpg"))["loss"] == pytest.approx((1 - 2 + 1.0) / 3)
    assert one(L.policy_loss(df, "clip_cov"))["loss"] == pytest.approx(-1.0)  # the token of covariance 1.39 goes
    for name in L.LOSSES:
        assert np.isfinite(one(L.policy_loss(df, name))["loss"])
    with pytest.raises(ValueError):
        L.policy_loss(df, "nothing")


def test_covariance_cuts_against_a_loop(spark):
    """Which tokens clip_cov and kl_cov pick, with ties in the covariance, by a sort of all tokens."""
    rng = np.random.default_rng(9)
    rows = [(i, *[np.round(rng.normal(0, 1, 6), 1).tolist() for _ in range(3)], rng.integers(0, 2, 6).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, logp array<double>, old_logp array<double>, advantages array<double>, mask array<int>")
    places = df.select("row_id", F.posexplode("logp")).select("row_id", "pos").withColumn("h", F.xxhash64("row_id", "pos")).collect()
    own = {r[0]: r[1:] for r in rows}
    t = [(r["h"], r["row_id"], r["pos"], *[x[r["pos"]] for x in own[r["row_id"]]]) for r in places]
    lp, old, adv, mask = (np.array([x[3 + j] for x in t]) for j in range(4))
    n = mask.sum() + 1e-8
    cov = (adv - (adv * mask).sum() / n) * (lp - (lp * mask).sum() / n)
    ratio = np.exp(lp - old)
    first, second = -adv * ratio, -adv * np.clip(ratio, 0.8, 1.2)
    able = [i for i in range(len(t)) if mask[i] and 0.1 < cov[i] < 5 and not second[i] > first[i]]
    gone = sorted(able, key=lambda i: t[i][:3])[: int(0.1 * mask.sum())]
    keep = np.ones(len(t))
    keep[gone] = 0
    got = one(L.policy_loss(df, "clip_cov", ratio=0.1, lower=0.1, upper=5.0))
    assert 1 < len(gone) < len(able)
    assert got["loss"] == pytest.approx((np.maximum(first, second) * keep * mask).sum() / mask.sum())
    assert got["clipfrac"] == pytest.approx(len(gone) / mask.sum())
    used = [i for i in range(len(t)) if mask[i]]
    top = sorted(used, key=lambda i: (-cov[i], *t[i][1:3]))[: int(len(used) * 0.2)]
    want = sum(-adv[i] * ratio[i] for i in used) + sum(0.5 * abs(lp[i] - old[i]) for i in top)
    assert one(L.policy_loss(df, "kl_cov", share=0.2, coefficient=0.5))["loss"] == pytest.approx(want / len(used))


def test_data_metrics_fixture(spark):
    ones = [1, 1]
    data = [([1.0, 2.0], [0.5, 1.0], [0.1, 0.2], [1.1, 1.2], [0.9, 1.0], ones, 2.0), ([3.0, 4.0], [1.5, 2.0], [0.3, 0.4], [1.3, 1.4], [1.1, 1.2], ones, 2.0)]
    df = spark.createDataFrame(data, "scores array<double>, rewards array<double>, advantages array<double>, returns array<double>, values array<double>, mask array<int>, prompt_length double")
    got = one(M.data_metrics(df, max_response=2, max_prompt=2))
    assert (got["score_mean"], got["score_max"], got["score_min"], got["reward_mean"]) == (5.0, 7.0, 3.0, 2.5)
    assert got["response_length_mean"] == 2 and got["response_clip_ratio"] == 1.0
    with pytest.raises(PySparkException):
        M.data_metrics(df.withColumn("mask", F.transform("mask", lambda m: m * 0)), max_response=2, max_prompt=2).collect()


def test_metric_rules(spark):
    names = ["timing_s/x_mean", "reward/mean", "a/max", "b/min_max", "c/total", "perf/time_per_step", "training/global_step", "z/weighted_avg", "other"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(M.rule_of(F.col("name"))).collect()]
    assert got == ["sum", "avg", "max", "max", "sum", "sum", "last", "avg", "avg"]
    agg = spark.createDataFrame([("global_seqlen/max", 9.0), ("global_seqlen/min", 4.0), ("global_seqlen/minmax_diff", 1.0), ("timing_s/gen", 2.0), ("timing_s/step", 8.0)], "name string, value double")
    made = {r["name"]: r["value"] for r in M.derived_metrics(agg, 8).collect()}
    assert made["global_seqlen/minmax_diff"] == 5.0 and made["trainer/idle_ratio"] == 0.25


def test_rollup_fixture_and_bootstrap(spark):
    df = spark.createDataFrame([(0, "source1", "p1", 0.8, "A"), (1, "source1", "p1", 0.9, "B"), (2, "source2", "p2", 0.7, "A")], "row_id long, data_source string, uid string, score double, pred string")
    got = {(r["data_source"], r["metric"]): r["value"] for r in E.rollup(df, ["score"], vote="pred").collect()}
    assert got["source1", "mean@2"] == pytest.approx(0.85) and got["source2", "mean@1"] == 0.7 and ("source1", "maj@2/mean") in got
    (best, _), (worst, _) = E.bootstrap([0.8, 0.9], 2, [max, min])
    assert got["source1", "best@2/mean"] == pytest.approx(best) and got["source1", "worst@2/mean"] == pytest.approx(worst)
    assert best == pytest.approx(0.875, abs=0.01)
    assert E.majority([("A", 1), ("B", 2), ("A", 3)]) == 1 and E.majority([("B", 2), ("A", 1)]) == 2
    assert E.subset_sizes(1) == [1] and E.subset_sizes(2) == [2] and E.subset_sizes(10) == [2, 4, 8, 10]


def test_bootstrap_query_takes_all_prompts_and_draws(spark, sf):
    prompts = {}
    for r in scoring_queries._scores(spark, sf).orderBy("row_id").collect():
        prompts.setdefault((r["data_source"], r["uid"]), []).append((r["pred"], r["score"]))
    want = {}
    for (source, _), pairs in prompts.items():
        values, n = [v for _, v in pairs], len(pairs)
        want.setdefault((source, f"mean@{n}"), []).append(float(np.mean(values)))
        for k in E.subset_sizes(n) if n > 1 else ():
            for name, f in (("best", max), ("worst", min)):
                want.setdefault((source, f"{name}@{k}/mean"), []).append(E.bootstrap(values, k, [f])[0][0])
            want.setdefault((source, f"maj@{k}/mean"), []).append(E.bootstrap(pairs, k, [E.majority])[0][0])
    got = {(r["data_source"], r["metric"]): r["value"] for r in scoring_queries.eval_rollup_bootstrap(spark, sf).collect()}
    assert want and {k: got[k] for k in want} == {k: pytest.approx(float(np.mean(v)), abs=2e-6) for k, v in want.items()}


def test_balance_queries_take_all_conversations(spark, sf):
    lengths = dict(spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.length("text"))).collect())
    assert len(lengths) > 16
    for made, part in ((batch_queries.balanced_parts(spark, sf), "part"), (more_queries.micro_batches(spark, sf), "micro")):
        rows = made.collect()
        assert {r["row_id"]: r["seqlen"] for r in rows} == lengths and len(rows) == len(lengths)
        sums = {}
        for r in rows:
            sums[r[part]] = sums.get(r[part], 0) + r["seqlen"]
        assert max(sums.values()) - min(sums.values()) <= max(lengths.values())
    report = batch_queries.balance_report(spark, sf).first()
    assert report["after_mean"] == pytest.approx(sum(lengths.values()) / 8)


def test_kl_path_of_all_events(spark, sf):
    want, at = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").filter("value is not null").orderBy("event_id").collect():
        step, b = at.get(r["event_type"], (0, 0.2))
        at[r["event_type"]] = step + 1, b * (1 + max(-0.2, min(0.2, r["value"] / 10 - 1)) * 64 / 1000)
        want[r["event_type"], step + 1] = at[r["event_type"]][1]
    got = {(r["name"], r["step"]): r["coefficient"] for r in loss_queries.adaptive_kl_path_all(spark, sf).collect()}
    assert len(want) == 1000 and got == {k: pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items()}


def test_balancing():
    rng = random.Random(1)
    for equal in (False, True):
        lengths = [rng.randint(1, 5000) for _ in range(96)]
        parts = B.balanced(lengths, 8, equal)
        assert sorted(i for p in parts for i in p) == list(range(96))
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < max(lengths) and (not equal or {len(p) for p in parts} == {12})
        place = B.restore(parts)
        flat = [i for p in parts for i in p]
        assert [flat[place[i]] for i in range(96)] == list(range(96))
    uids = [u for u in "abcdefgh" for _ in range(rng.randint(1, 5))]
    lengths = [rng.randint(1, 100) for _ in uids]
    groups = B.balanced_groups(lengths, uids, 4)
    owners = [{uids[i] for i in p} for p in groups]
    assert all(len(o) == 2 for o in owners) and len(set().union(*owners)) == 8
    micro = B.micro_batches(lengths, 150, divided_by=2)
    assert len(micro) % 2 == 0 and sorted(i for p in micro for i in p) == list(range(len(lengths)))
    with pytest.raises(ValueError):
        B.balanced([1, 2, 3], 2, True)
    assert sorted(sum(p, [])) == [0, 1, 2, 3] if (p := B.greedy([5, 1, 1, 1], 2)) else False


def test_verbs(spark):
    df = spark.createDataFrame([(i, [float(i), i + 0.5], "abcdef"[i]) for i in range(6)], "row_id long, obs array<double>, labels string")
    get = lambda d: [r["labels"] for r in d.orderBy("row_id").collect()]
    assert get(verbs.gather(df, [3, 4, 2, 0, 1, 5])) == list("decabf")
    assert get(verbs.repeat(df, 2)) == list("aabbccddeeff") and get(verbs.repeat(df, 2, interleave=False)) == list("abcdefabcdef")
    assert get(verbs.repeat_each(df, F.col("row_id").cast("int"))) == list("bccdddeeeefffff")
    padded, extra = verbs.pad_to_divisor(df, 16)
    assert extra == 10 and get(padded) == list("abcdefabcdefabcd") and get(verbs.unpad(padded, extra)) == list("abcdef")
    for s in ((None, None, None), (1, 4, None), (-3, None, None), (None, None, 2), (None, None, -1), (4, 0, -2), (9, None, None)):
        assert get(verbs.slice_rows(df, *s)) == list("abcdef")[slice(*s)]
    assert verbs.equal(verbs.unfold_rows(verbs.fold(df.drop("obs"), 3), ["labels"]), df.drop("obs"))
    parts = verbs.chunk(df, 3)
    assert verbs.equal(verbs.concat([verbs.renumber(parts.filter(F.col("part") == k).drop("part")) for k in range(3)]), df)
    assert get(verbs.padding(df, 2, "first")) == list("abcdefaa")
    runs = spark.createDataFrame([(i, k) for i, k in enumerate([5, 5, 7, 7, 7, 5])], "row_id long, key int")
    assert [r["run_pos"] for r in verbs.run_positions(runs, "key").orderBy("row_id").collect()] == [0, 1, 0, 1, 2, 0]
    seeded = verbs.batches(df, 2, 3, seed=1).collect()
    assert len(seeded) == 18 and all(sum(r["epoch"] == e and r["batch"] == b for r in seeded) == 2 for e in range(3) for b in range(3))
    pick = np.random.default_rng(4).choice(6, size=3, replace=False)
    assert get(verbs.sample_rows(df, 3, shuffle=True, seed=4)) == ["abcdef"[i] for i in pick]


def test_union_checks_common_columns(spark):
    left = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "row_id long, x double")
    assert verbs.union(left, left.withColumn("y", F.lit(1))).count() == 2
    with pytest.raises(PySparkException):
        verbs.union(left, left.withColumn("x", F.lit(9.0))).collect()
    with pytest.raises(PySparkException):
        verbs.union(left, left.filter("row_id = 0").withColumn("y", F.lit(1))).collect()
    with pytest.raises(ValueError):
        verbs.chunk(left, 3)
    with pytest.raises(KeyError):
        verbs.select(left, ["absent"])


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [0, 1, 0, 1, 1])], "a array<int>, m array<int>")
    get = lambda c: df.select(c).first()[0]
    assert get(A.truncate("a", 3, "left")) == [3, 4, 5] and get(A.truncate("a", 3, "right")) == [1, 2, 3] and get(A.truncate("a", 3, "middle")) == [1, 4, 5]
    assert get(A.pad("a", 7, F.lit(0))) == [1, 2, 3, 4, 5, 0, 0] and get(A.pad("a", 7, F.lit(0), left=True)) == [0, 0, 1, 2, 3, 4, 5]
    assert get(A.strip_padding("a", "m")) == [2, 4, 5] and get(A.positions("m")) == [0, 0, 0, 1, 2]
    assert get(A.first_end_mask("a", F.lit(3))) == [1, 1, 1, 0, 0] and get(A.first_end_mask("a", F.lit(9))) == [1] * 5
    with pytest.raises(PySparkException):
        get(A.truncate("a", 3))
    whole = S.group_mean_std(spark.createDataFrame([("a", 1.0)], "uid string, s double"), "s", "uid").first()
    assert (whole["mean"], whole["std"]) == (0.0, 1.0)
