import base64
import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import preference, queries, sharding, topk, warc
from tallyweave.llm.common import scratch_path, table
from tallyweave.llm.components import component_labels


# --- sharding -------------------------------------------------------------------------------------


def check_shards(rows, shards=8, tolerance=0.05):
    total = sum(r["size"] for r in rows)
    load, slots, groups = [0] * shards, {}, {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    largest = max(r["size"] for r in rows)
    assert max(load) - min(load) <= tolerance * total / shards + 2 * largest
    return groups


def brute_shards(rows, shards=8):
    """The operator's rule, spelled out: (doc_id, size, crc, shard) of (doc_id, text) rows."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = {}
    for i, text in rows:
        raw = (text or "").encode()
        groups.setdefault((signed(xxhash.xxh64_intdigest(raw, 42)), zlib.crc32(raw), len(raw) + 1), []).append(i)
    total, count = sum(k[2] * len(v) for k, v in groups.items()), len(rows)
    large = [k for k in sorted(groups) if k[2] * len(groups[k]) * sharding.HEAVY > total or len(groups[k]) * sharding.HEAVY > count]
    load, out = [0.0] * shards, []
    for k in sorted(large, key=lambda k: (-k[2] * len(groups[k]), large.index(k))):
        assert k[2] * len(groups[k]) <= total / shards  # splits have a test of their own
        s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += k[2] * len(groups[k])
        out += [(i, k[2], k[1], s) for i in groups[k]]
    room = [max(0.0, total / shards - x) for x in load]
    rest = sum(k[2] * len(groups[k]) for k in groups if k not in large)
    cuts = [rest * sum(room[: s + 1]) / (sum(room) or 1) for s in range(shards - 1)]
    at = 0
    for k in sorted(set(groups) - set(large)):
        size = k[2] * len(groups[k])
        out += [(i, k[2], k[1], sum(at + size / 2 >= c for c in cuts)) for i in groups[k]]
        at += size
    return out


@pytest.mark.parametrize("heavy", [sharding.HEAVY, 40])
def test_sharding_against_brute_force(spark, sf, monkeypatch, heavy):
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    df = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (5, ""), (5, "")], "doc_id long, text string"))
    got = [tuple(r) for r in sharding.shard_rows(df, 8).select("doc_id", "size", "text_crc32", "shard").collect()]
    assert sorted(got, key=str) == sorted(brute_shards([(r["doc_id"], r["text"]) for r in df.collect()]), key=str)


def test_sharding(spark, sf):
    rows = sharding.shard_rows(table(spark, sf, "documents")).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(len(s) == 1 for s in check_shards(rows).values())


def test_sharding_with_a_group_of_a_third(spark):
    rows = [(i, "the same text " * 10) for i in range(2000)] + [(2000 + i, f"text {i} " * (i % 40)) for i in range(4000)] + [(9000, None), (9001, ""), (None, "x"), (9002, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9))
    got = sharding.shard_rows(df).collect()
    assert len(got) == len(rows)
    groups = check_shards(got)
    assert sum(len(s) > 1 for s in groups.values()) == 1  # only the group larger than a shard is split


def test_sharding_of_nothing(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- preference pairs -----------------------------------------------------------------------------


def test_preference_by_hand(spark):
    turn = lambda r, t: {"role": r, "text": t}
    chosen = [turn("user", "hi"), turn("assistant", "yes"), turn("user", "ok")]
    rejected = [turn("user", "hi"), turn("assistant", "no")]
    kind = "array<struct<role: string, text: string>>"
    df = spark.createDataFrame([(1, chosen, rejected, "x"), (2, chosen, chosen, "x"), (3, [], rejected, "x")], f"id long, chosen {kind}, rejected {kind}, prompt string")
    got = {r["id"]: r for r in preference.format_pairs(df).collect()}
    assert got[1]["prefix_turns"] == 1 and got[1]["prompt"] == "<|start|>user\nhi<|end|>\n"
    for side, text in (("chosen", "yes"), ("rejected", "no")):
        whole, (span,) = got[1][f"{side}_text"], got[1][f"{side}_mask"]
        assert whole[span["start"] : span["start"] + span["length"]] == text + "<|end|>\n"
    assert got[2]["prefix_turns"] == 3 and got[2]["chosen_text"] == got[2]["rejected_text"] == "" and got[2]["chosen_mask"] == []
    assert got[3]["prefix_turns"] == 0 and got[3]["prompt"] == "" and got[3]["chosen_text"] == ""


def test_preference_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "lost"), (2, 0, "assistant", "only"), (2, 1, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(0))
    got = {r["conv_id"]: r for r in preference.format_pairs(preference.neighbour_pairs(df)).collect()}
    assert set(got) == {1, 2}
    assert got[1]["prefix_turns"] == 3 and got[2]["prefix_turns"] == 1 and "last" in got[2]["chosen_text"]
    assert preference.format_pairs(preference.neighbour_pairs(df.filter("conv_id = 9"))).count() == 0


def test_preference_runs_without_python(spark, sf):
    plan = queries.op3_preference(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- top k ----------------------------------------------------------------------------------------


def brute_top(rows, queries_, k):
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    whole = [(i, [clip(math.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q in queries_:
            best = sorted((-clip(sum(a * b for a, b in zip(v, c, strict=True))), i) for i, c in whole if i != q and len(c) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("query_bytes", [16 << 20, 1000])
def test_top_k(spark, sf, query_bytes):
    df = table(spark, sf, "embeddings")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, query_bytes=query_bytes).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, set(range(0, 10000, 50)), 5))


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (50, [0.1, 0.1]), (None, [1.0, 1.0]), (100, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, {0, 50, 100}, 5))
    assert topk.top_k(df.filter("vec_id = 99"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("query_bytes", [16 << 20, 40])
def test_top_k_of_large_values(spark, query_bytes):
    rng = np.random.default_rng(8)
    large = [(i, [float(x) for x in rng.integers(-(1 << 40), 1 << 40, 6)]) for i in range(60)]
    large += [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60, 120)] + [(200, [1e6, 0.0, 0.0, 0.0, 0.0, 0.0]), (250, [1e6, 1.0, 0.0, 0.0, 0.0, 0.0]), (251, [1e300] * 6), (252, [-1e300] * 6), (300, [1e300] * 6)]
    got = topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, query_bytes=query_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(large, {0, 50, 100, 200, 250, 300}, 5))


# --- preference names ---


def test_format_pairs_leaves_other_columns(spark):
    turns = "array<struct<role: string, text: string>>"
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], "own", 7)], f"chosen {turns}, rejected {turns}, _c string, _chosen_rest int")
    (r,) = preference.format_pairs(df).collect()
    assert (r["_c"], r["_chosen_rest"], r["prefix_turns"]) == ("own", 7, 1)


# --- WARC -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_bytes", [warc.BROADCAST_BYTES, 0])
def test_warc_round_trip(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(i, f"http://x/{i} y", ("page %d " % i) * (i * 50)) for i in range(1, 60)] + [(100, None, None), (101, "u", ""), (102, "u", "same"), (103, "u", "same"), (103, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (104, "u", "é漢\x1f\x8b\x08")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    files = warc.archive_pages(df)
    for span in (warc.RANGE, 700, 37):
        got = warc.read_archives(files, span=span).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["payload"] is None) == (r["record_type"] == "revisit")
        full = {r["payload_digest"]: r["payload"] for r in got if r["payload"] is not None}
        want = sorted((str(i), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode())) for i, _, h in rows)
        assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == want
        assert all(d in full for _, d, _ in want)
        assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(101, 100), (103, 102), (None, 102)}


def test_warc_ranges_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 2000)
    rng = np.random.default_rng(3)
    rows = [(i, "u", rng.bytes(400).hex()) for i in range(80)]
    files = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    ranges = warc._ranges(files, 700)
    at = [r["p"] for r in ranges.select(F.spark_partition_id().alias("p")).collect()]
    assert len(at) >= 40 and max(map(at.count, at)) <= 4 and len(set(at)) >= 10
    got = warc.read_archives(files, span=700, payloads=False)
    assert "payload" not in got.columns and sorted(r["page_id"] for r in got.collect()) == list(range(80))


def test_warc_least_payload_and_files(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string").coalesce(1)
    files = warc.archive_pages(df, least=3, path=scratch_path(spark, "warc-test"))
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(files).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    for r in files.collect():
        with gzip.open(r["file"].removeprefix("file://")) as f:
            assert f.read().startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(warc.archive_pages(df.filter("page_id = 9"))).count() == 0


# --- components -----------------------------------------------------------------------------------


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}
    assert component_labels(spark.createDataFrame([], "u long, v long")).count() == 0


def test_topk_discards_candidates(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(256 * np.array([r["embedding"] for r in rows], np.float64))
    asked = np.flatnonzero(ids % 50 == 0)
    full = x[asked] @ x.T
    full[np.arange(len(asked)), asked] = -np.inf
    want = [sorted(zip((-row).tolist(), ids.tolist(), strict=True))[:5] for row in full]
    for least, share in ((None, 0.65), (np.sort(full, 1)[:, -5], 0.45)):
        best = [[] for _ in asked]
        done = topk.search_block(ids, np.ascontiguousarray(x.T), ids[asked], x[asked], best, 5, least=least)
        assert [[(s, i) for s, i in b] for b in best] == want
        assert done < share * len(asked) * x.size
