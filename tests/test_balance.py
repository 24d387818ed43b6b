"""Balancing of tables by mergeable partial solutions: one method at every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import balance as B


def table(spark, lengths, uids=None):
    rows = [(10 * i, int(n), None if uids is None else uids[i], "x") for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "row_id long, seqlen int, uid string, part_name string").repartition(3)


def members(got, part="part"):
    out = {}
    for r in got:
        out.setdefault(r[part], []).append((r["place"], r["row_id"]))
    for own in out.values():
        assert sorted(p for p, _ in own) == list(range(len(own))) and [i for _, i in sorted(own)] == sorted(i for _, i in own)
    return {p: [i // 10 for _, i in sorted(own)] for p, own in out.items()}


def padded_differencing(lengths, parts, equal_size):
    """The plain algorithm on whole k-tuples."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    step = parts if equal_size else 1
    key = lambda s: (-s[0], -len(s[1]), s[1])
    states = [sorted([(lengths[i], [i]) for i in order[a : a + step]] + [(0, [])] * (parts - step), key=key) for a in range(0, len(order), step)]
    rank = lambda sets: (-(sets[0][0] - sets[-1][0]), [(-s, x) for s, x in sets])
    while len(states) > 1:
        states.sort(key=rank)
        a, b = states.pop(0), states.pop(0)
        states.append(sorted([(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)], key=key))
    return [sorted(x) for _, x in states[0]]


@pytest.mark.parametrize("equal", [False, True])
def test_sets_without_padding_give_the_plain_result(equal):
    rng = np.random.default_rng(2)
    for n, parts in ((12, 3), (24, 8), (40, 5), (6, 6), (64, 16)):
        for high in (3, 50, 5000):
            lengths = rng.integers(0 if high == 3 else 1, high, n).tolist()
            if not equal or n % parts == 0:
                assert B.differencing(lengths, parts, equal) == padded_differencing(lengths, parts, equal)


def test_one_run_is_the_plain_result(spark):
    lengths = np.random.default_rng(1).integers(1, 900, 120).tolist()
    for options in ({}, {"equal_size": True}, {"how": "greedy"}, {"work": True}):
        got = members(B.assign(table(spark, lengths), 6, **options).collect())
        cost = [B.LINEAR * n + n * n for n in lengths] if options.get("work") else lengths
        want = B.greedy(cost, 6) if options.get("how") else B.differencing(cost, 6, options.get("equal_size", False))
        assert got == dict(enumerate(want)), options


@pytest.mark.parametrize("options", [{}, {"equal_size": True}, {"how": "greedy"}])
def test_many_runs_merge_in_a_tree(spark, monkeypatch, options):
    monkeypatch.setattr(B, "CHUNK", 24)
    monkeypatch.setattr(B, "FAN", 3)
    lengths = np.random.default_rng(3).integers(1, 2000, 480).tolist()
    got = members(B.assign(table(spark, lengths), 8, **options).collect())
    assert sorted(i for own in got.values() for i in own) == list(range(480)) and set(got) == set(range(8))
    sums = [sum(lengths[i] for i in own) for own in got.values()]
    assert max(sums) - min(sums) <= max(lengths) if options.get("how") else max(sums) - min(sums) <= 8  # the plain form: 1 or so
    if options.get("equal_size"):
        assert {len(own) for own in got.values()} == {60}


def test_over_one_tree_of_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "WIDE", 8)
    monkeypatch.setattr(B, "CHUNK", 32)
    lengths = np.random.default_rng(4).integers(1, 500, 600).tolist()
    got = members(B.assign(table(spark, lengths), 30).collect())
    assert set(got) == set(range(30)) and sorted(i for own in got.values() for i in own) == list(range(600))
    sums = [sum(lengths[i] for i in own) for own in got.values()]
    assert max(sums) - min(sums) < 0.2 * sum(sums) / 30
    equal = members(B.assign(table(spark, lengths), 30, equal_size=True).collect())
    assert {len(own) for own in equal.values()} == {20}


def test_runs_of_a_uid_stay_whole(spark, monkeypatch):
    rng = np.random.default_rng(5)
    uids = [u for k in range(48) for u in [f"u{k % 7}" if k % 7 != 6 else None] * rng.integers(1, 5)]
    lengths = rng.integers(1, 300, len(uids)).tolist()
    want = B.balanced_groups(lengths, uids, 4)
    got = B.assign(table(spark, lengths, uids), 4, uid="uid").collect()
    assert members(got) == dict(enumerate(want))
    monkeypatch.setattr(B, "CHUNK", 8)
    part = {r["row_id"]: r["part"] for r in B.assign(table(spark, lengths, uids), 4, uid="uid").collect()}
    assert len({p for p in part.values()}) == 4
    for i in range(1, len(uids)):
        if uids[i] == uids[i - 1]:
            assert part[10 * i] == part[10 * (i - 1)]


def test_micro_batches_of_any_number(spark, monkeypatch):
    lengths = np.random.default_rng(6).integers(1, 400, 150).tolist()
    plain = B.micro_batches(lengths, 1000, divided_by=4)
    assert members(B.assign_micro(table(spark, lengths), 1000, divided_by=4).collect(), "micro") == dict(enumerate(plain))
    monkeypatch.setattr(B, "CHUNK", 32)
    monkeypatch.setattr(B, "WIDE", 8)
    got = members(B.assign_micro(table(spark, lengths), 1000, divided_by=4).collect(), "micro")
    assert len(got) == len(plain) and sorted(i for own in got.values() for i in own) == list(range(150))


def test_defined_errors_and_empty_tables(spark):
    with pytest.raises(ValueError, match="don't divide"):
        B.assign(table(spark, [1, 2, 3]), 2, equal_size=True)
    with pytest.raises(ValueError, match="for 5 parts"):
        B.assign(table(spark, [1, 2, 3]), 5)
    with pytest.raises(ValueError, match="over the budget"):
        B.assign_micro(table(spark, [1, 20]), 10)
    none = table(spark, [1]).filter(F.col("row_id") < 0)
    assert B.assign_micro(none, 10).collect() == [] and "micro" in B.assign_micro(none, 10).columns
