"""Balanced shards by global byte-size prefix sums (operator 2).

Equal texts are kept together. Their groups, ordered by hash, are range-partitioned; each
partition's byte total is summed up, so that every group knows the bytes before it, and the
line of groups is cut where shards reach their targets. A group of more than one part in
HEAVY of all bytes or rows is placed by size beforehand, largest first to the least loaded
shard, and the cuts share out the room that is left; only a group larger than a whole shard
is split, by prefix sums over its own rows.

Defined results: a null text counts as empty. Rows that repeat a doc_id are placed each. A
null doc_id sorts first. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize
from tallyweave.llm.ranks import prefix_sums

#: A group over one part in so many is placed by itself; there are at most twice as many such groups.
HEAVY = 4096
_GROUP = ["key", "text_crc32", "size"]


def place_heavy(groups: list[tuple[int, int]], shards: int, target: float) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Shards for (size of a row, rows) groups, and the shards' loads.

    Each group gets a list of (shard, rows): one entry unless it is larger than a shard's target.
    """
    load = [0.0] * shards
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    for g in sorted(range(len(groups)), key=lambda g: (-groups[g][0] * groups[g][1], g)):
        size, rows = groups[g]
        while rows:
            s = min(range(shards), key=lambda s: (load[s], s))
            take = rows
            if size * rows > target:
                take = min(rows, max(1, round((target - load[s]) / size)))
            out[g].append((s, take))
            load[s] += size * take
            rows -= take
    return out, load


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): sizes are UTF-8 bytes plus 1, slots gapless from 0 in a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    groups = materialize(rows.groupBy(*_GROUP).agg(F.count("*").alias("rows")), "shard-groups")
    whole = groups.agg(F.coalesce(F.sum(F.col("size") * F.col("rows")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    target = whole["bytes"] / shards
    heavy = (F.col("size") * F.col("rows") * HEAVY > whole["bytes"]) | (F.col("rows") * HEAVY > whole["rows"])
    large = groups.filter(heavy).orderBy(*_GROUP).collect()  # at most 2 * HEAVY rows
    placed, load = place_heavy([(r["size"], r["rows"]) for r in large], shards, target)
    room = [max(0.0, target - x) for x in load]
    light = groups.filter(~heavy)
    total = light.agg(F.sum(F.col("size") * F.col("rows")).alias("b")).first()["b"] or 0
    cuts, at = [], 0.0
    for r in room[:-1]:
        at += r * total / (sum(room) or 1)
        cuts.append(at)
    before = prefix_sums(light, [], _GROUP, F.col("size") * F.col("rows"), "before")
    middle = F.col("before") + F.col("size") * F.col("rows") / 2
    shard = sum([F.when(middle >= c, 1).otherwise(0) for c in cuts], F.lit(0))
    named = before.select(*_GROUP, shard.cast("int").alias("shard"))
    whole_groups = [(*(r[c] for c in _GROUP), p[0][0]) for r, p in zip(large, placed, strict=True) if len(p) == 1]
    parts = [(*(r[c] for c in _GROUP), p) for r, p in zip(large, placed, strict=True) if len(p) > 1]
    kinds = "key long, text_crc32 long, size long"
    fixed = spark.createDataFrame(whole_groups, f"{kinds}, shard int")
    split = spark.createDataFrame([(*x[:3], [(s, sum(n for _, n in x[3][: k + 1])) for k, (s, _) in enumerate(x[3])]) for x in parts], f"{kinds}, ends array<struct<shard: int, upto: long>>")
    big = spark.createDataFrame([tuple(r[c] for c in _GROUP) for r in large], kinds)
    out = rows.join(F.broadcast(fixed), _GROUP).select("doc_id", *_GROUP, "shard")
    out = out.unionByName(rows.join(F.broadcast(big), _GROUP, "left_anti").join(named, _GROUP).select("doc_id", *_GROUP, "shard"))
    if parts:
        ranked = prefix_sums(rows.join(F.broadcast(split), _GROUP).drop("ends"), _GROUP, ["doc_id"], F.lit(1), "nth")
        mine = ranked.join(F.broadcast(split), _GROUP).withColumn("shard", F.element_at(F.filter("ends", lambda e: F.col("nth") < e["upto"]), 1)["shard"])
        out = out.unionByName(mine.select("doc_id", *_GROUP, "shard"))
    slots = prefix_sums(out, ["shard"], ["doc_id", "key", "text_crc32", "size"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
