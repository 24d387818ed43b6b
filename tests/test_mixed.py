"""Positions of mixed sequences against a loop."""

import random

from tallyweave.functions import mixed


def loop(segments, merge=2):
    out, start = [], 0
    for length, t, h, w in segments:
        own = []
        if t is None:
            own = [(start + k,) * 3 for k in range(length or 0)]
        else:
            own = [(start + a, start + b, start + c) for a in range(t) for b in range(h // merge) for c in range(w // merge)]
        out += own
        start = max([start - 1, *(max(p) for p in own)]) + 1
    return out


def test_positions_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [[], [(0, None, None, None)], [(3, None, None, None)], [(None, 1, 4, 6)], [(None, 1, 1, 8), (2, None, None, None)], [(None, 0, 4, 4), (1, None, None, None)], [(None, None, None, None), (2, None, None, None)]]
    for _ in range(60):
        rows.append([(rng.randint(0, 6), None, None, None) if rng.random() < 0.5 else (None, rng.randint(1, 4), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(rng.randint(1, 7))])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "i int, s array<struct<length:int,t:int,h:int,w:int>>")
    for merge in (1, 2, 3):
        made = df.select("i", mixed.mixed_positions("s", merge).alias("p"))
        got = {r["i"]: r for r in made.withColumn("d", mixed.position_delta(made["p"])).collect()}
        assert got[-1]["p"] is None
        for i, r in enumerate(rows):
            want = loop(r, merge)
            assert [tuple(p) for p in got[i]["p"]] == want, r
            assert got[i]["d"] == (max(max(p) for p in want) + 1 - len(want) if want else 0)
