"""Cut logits and draws against numpy, with ties at the border."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import nucleus as N


def numpy_top_k(x, k):
    return np.where(x >= np.sort(x)[::-1][min(k, len(x)) - 1], x, -np.inf) if len(x) else x


def numpy_top_p(x, p, min_keep=1):
    if not len(x):
        return x
    order = np.lexsort((np.arange(len(x)), -x))
    share = np.exp(x - x.max())
    before = np.concatenate([[0.0], np.cumsum(share[order])[:-1]])
    stay = order[(before < p * share.sum()) | (np.arange(len(x)) < min_keep)]
    out = np.full(len(x), -np.inf)
    out[stay] = x[stay]
    return out


def rows(rng, n=60):
    made = [[], [1.0], [2.0, 2.0, 2.0, 2.0], [float("-inf"), 0.0, float("-inf"), 0.0], [5.0, 1.0, 1.0, 1.0]]
    return made + [np.floor(rng.normal(0, 2, rng.integers(1, 40))).tolist() for _ in range(n)]


@pytest.mark.parametrize(("k", "p", "temperature"), [(3, None, 1.0), (1, None, 0.5), (100, None, 1.0), (None, 0.9, 1.0), (None, 0.01, 1.0), (5, 0.7, 0.7), (0, 1.0, 2.0), (None, 0.5, 1.0)])
def test_cuts_equal_numpy(spark, k, p, temperature):
    own = rows(np.random.default_rng(k or 7))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(own)] + [(len(own), None)], "i int, x array<double>")
    got = {r["i"]: r["y"] for r in df.select("i", N.processed("x", temperature, k, p).alias("y")).collect()}
    assert got.pop(len(own)) is None
    for i, r in enumerate(own):
        want = np.array(r) / temperature
        want = numpy_top_k(want, k) if k else want
        want = numpy_top_p(want, p) if p and p < 1 else want
        assert got[i] == want.tolist(), (r, got[i])


def test_least_kept(spark):
    df = spark.createDataFrame([([9.0, 1.0, 1.0, 0.0],)], "x array<float>")
    got = df.select(N.top_p("x", 0.1, min_keep=3).alias("p"), N.top_k("x", 1, min_keep=2).alias("k"), N.kept(N.top_p("x", 0.1)).alias("kept")).first()
    assert got["p"] == [9.0, 1.0, 1.0, float("-inf")] and got["k"] == [9.0, 1.0, 1.0, float("-inf")] and got["kept"] == [9.0]


def test_draws_follow_the_shares(spark):
    x = [1.0, float("-inf"), 2.0, 0.0]
    df = spark.range(4000).select(F.array(*[F.lit(v) for v in x]).alias("x"), ((F.col("id") + 0.5) / 4000).alias("u"))
    got = [r["n"] for r in df.groupBy(N.drawn("x", F.col("u")).alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()]
    share = np.exp([1.0, 2.0, 0.0]) / np.exp([1.0, 2.0, 0.0]).sum()
    assert np.abs(np.array(got) / 4000 - share).max() < 1e-3
    ends = spark.range(1).select(N.drawn(F.array(*[F.lit(v) for v in x]), F.lit(0.0)).alias("a"), N.drawn(F.array(*[F.lit(v) for v in x]), F.lit(1.0)).alias("b"), N.drawn(F.array().cast("array<double>"), F.lit(0.5)).alias("c")).first()
    assert (ends["a"], ends["b"], ends["c"]) == (0, 3, None)
