import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import queries, whitening
from tallyweave.llm.common import table

ROWS = "vec_id long, embedding array<float>, n int, whitened string"


def brute(vectors, scale=1024, offset=100_000):
    """(whole vectors, n, sums, covariance as whole numbers over n * n), by Python's integers."""
    x = [[int(np.floor(scale * float(c))) + offset for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    cov = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    return x, n, s, cov


def test_limbs_and_digits_give_back_their_numbers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64), np.array([0, -1, (1 << 63) - 1, -(1 << 63), 1 << 16, -(1 << 16)])])
    for bits in (16, 20):
        parts = whitening.limbs(x, bits)
        assert [sum(int(p[i]) << (bits * k) for k, p in enumerate(parts)) for i in range(len(x))] == x.tolist()
        assert all(np.abs(p.astype(object)).max() <= 1 << bits for p in parts)
    for v in (0, -1, 1 << 170, -(1 << 170) + 12345, *x.tolist()):
        assert sum(d << (whitening.DIGIT * k) for k, d in enumerate(whitening.digits(v))) == v


@pytest.mark.parametrize("far", [1 << 10, 1 << 20, 1 << 62])
def test_products_and_deviations_are_exact(far, monkeypatch):
    monkeypatch.setattr(whitening, "LONG_ROWS", 100)
    rng = np.random.default_rng(far)
    x = rng.integers(-far, far, (230, 5), dtype=np.int64)
    made = whitening.Products(5)
    for at in range(0, 230, 60):
        made.add(x[at : at + 60])
    made.flush()
    rows = [[1, *map(int, r)] for r in x]
    assert made.total.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(6)] for i in range(6)]
    sums = [sum(r[i + 1] for r in rows) for i in range(5)]
    d, squares = whitening.deviations(x, 230, sums)
    assert squares == [sum((230 * r[i + 1] - sums[i]) ** 2 for i in range(5)) for r in rows]
    assert d.tolist() == [[float(230 * r[i + 1] - sums[i]) for i in range(5)] for r in rows]


def test_query_against_whole_numbers(spark, sf):
    got = queries.op12_whitening(spark, sf).toPandas()
    rows = table(spark, sf, "embeddings").collect()
    x, n, s, cov = brute([r["embedding"] for r in rows])
    assert set(got["n"]) == {n} and len(got) == 8 * n and set(got["component"]) == set(range(1, 9))
    v = np.array([[c / (n * n) for c in row] for row in cov])
    values, vectors = np.linalg.eigh(v)
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    for k in range(8):
        want = centred @ vectors[:, -1 - k] / np.sqrt(values[-1 - k])
        assert min(np.abs(own[:, k] - want).max(), np.abs(own[:, k] + want).max()) < 1e-6
        share = set(got.loc[got["component"] == k + 1, "explained"])
        assert len(share) == 1 and share.pop() == pytest.approx(values[-1 - k] / np.trace(v), rel=1e-9)
    deviation = {r["vec_id"]: sum((n * a - b) ** 2 for a, b in zip(w, s, strict=True)) for r, w in zip(rows, x, strict=True)}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == deviation
    (error,) = set(got["identity_error"])
    measured = np.abs(np.cov(own.T, bias=True) - np.eye(8)).max()
    assert error < 1e-9 and measured < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=3).astype(np.float32)], 1, "a") for i in range(20)]
    odd = [(None, [0.5, -0.25, 1.0], 2, None), (3, [0.5, -0.25, 1.0], 2, None), (50, None, 1, "b"), (51, [1.0, None, 2.0], 1, "c"), (52, [1.0, float("nan"), 2.0], 1, "d"), (53, [1.0, float("-inf"), 2.0], 1, "e"), (54, [], 1, "f"), (55, [1.0, 2.0], 1, "g")]
    found = whitening.whiten(spark.createDataFrame(good + odd, ROWS))
    got = whitening.component_rows(found).collect()
    assert sorted(r["vec_id"] for r in got if r["component"] == 1 and r["vec_id"] is not None) == sorted([*range(20), 3])
    assert {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {22} and sum(r["vec_id"] is None for r in got) == 3
    x, n, s, _ = brute([r[1] for r in good + odd[:2]])
    assert sorted(r["deviation"] for r in got if r["component"] == 2) == sorted(sum((n * a - b) ** 2 for a, b in zip(w, s, strict=True)) for w in x)


def test_no_variance_no_rows_and_large_values(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(4)], ROWS)
    got = whitening.whiten(same).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in got] == [([0.0, 0.0], [0.0, 0.0], 0, 0.0)] * 4
    for empty in ([], [(1, None, 0, "")], [(1, [], 0, "")]):
        found = whitening.whiten(spark.createDataFrame(empty, ROWS))
        assert found.collect() == [] and whitening.component_rows(found).collect() == []
    large = spark.createDataFrame([(1, [1e30, 0.0], 0, ""), (2, [-1e30, 1.0], 0, ""), (3, [1e10, 2.0], 0, "")], ROWS)
    got = whitening.component_rows(whitening.whiten(large)).collect()
    assert all(r["deviation"] is None for r in got) and len(got) == 6  # no long holds them
    wide = {r["vec_id"]: r["deviation"] for r in whitening.whiten(large.withColumn("embedding", F.transform("embedding", lambda v: F.least(v, F.lit(1e10).cast("float"))))).collect()}
    assert all(v is None or int(v) > 1 << 63 for v in wide.values())


def test_result_does_not_depend_on_partitions(spark, sf):
    rows = table(spark, sf, "embeddings").filter("vec_id < 90")
    shown = lambda df: {r["vec_id"]: (r["deviation"], [round(w, 9) for w in r["whitened"]]) for r in df.collect()}
    assert shown(whitening.whiten(rows.repartition(1))) == shown(whitening.whiten(rows.repartition(7, "vec_id")))
