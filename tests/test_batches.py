import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import tools
from tallyweave.operators import batches, flops, layout, order, verbs
from tallyweave.sources import sinks
from tallyweave.streaming import queues

#: Configurations and operations for lengths 512, 1024, 2048 and for three times 4096.
SMALL = {"vocab_size": 32000, "hidden_size": 4096, "intermediate_size": 11008, "num_hidden_layers": 32, "num_attention_heads": 32, "num_key_value_heads": 32}
EXPERTS = {"hidden_size": 2048, "vocab_size": 151936, "num_hidden_layers": 48, "num_key_value_heads": 4, "num_attention_heads": 32, "head_dim": 128, "moe_intermediate_size": 768, "num_experts_per_tok": 8, "num_experts": 128}
LATENT = {
    "hidden_size": 7168, "vocab_size": 129280, "moe_intermediate_size": 2048, "num_hidden_layers": 61, "first_k_dense_replace": 3, "num_attention_heads": 128, "n_routed_experts": 256, "num_experts_per_tok": 8,
    "n_shared_experts": 1, "kv_lora_rank": 512, "qk_rope_head_dim": 64, "v_head_dim": 128, "intermediate_size": 18432, "qk_nope_head_dim": 128, "q_lora_rank": 1536,
}
WINDOWS = {"vocab_size": 262208, "hidden_size": 3840, "intermediate_size": 15360, "num_hidden_layers": 48, "num_attention_heads": 16, "num_key_value_heads": 8, "head_dim": 256, "sliding_window": 1024, "layer_types": None, "sliding_window_pattern": 6}
OPEN = {
    "vocab_size": 201088, "hidden_size": 2880, "num_hidden_layers": 24, "num_attention_heads": 64, "num_key_value_heads": 8, "head_dim": 64, "intermediate_size": 2880, "num_local_experts": 32, "num_experts_per_tok": 4,
    "sliding_window": 128, "layer_types": ["sliding_attention", "full_attention"] * 12,
}
NORMED = {"vocab_size": 131072, "hidden_size": 4096, "intermediate_size": 21504, "num_hidden_layers": 32, "num_attention_heads": 32, "num_key_value_heads": 32}
SEEING = {
    "text_config": {"vocab_size": 151936, "hidden_size": 4096, "intermediate_size": 12288, "num_hidden_layers": 36, "num_attention_heads": 32, "num_key_value_heads": 8, "head_dim": 128},
    "vision_config": {
        "deepstack_visual_indexes": [8, 16, 24], "num_heads": 16, "depth": 27, "hidden_size": 1152, "intermediate_size": 4304, "out_hidden_size": 4096, "spatial_merge_size": 2, "temporal_patch_size": 2, "in_channels": 3, "patch_size": 16,
    },
}
KNOWN = [
    ("llama", SMALL, 149226491215872, 536372695793664),
    ("qwen3_moe", EXPERTS, 78593069678592, 306570470621184),
    ("deepseek_v3", LATENT, 848766538088448, 3145850406567936),
    ("gemma3_text", WINDOWS, 279084659638272, 963929979224064),
    ("gpt_oss", OPEN, 91780464771072, 323953008574464),
    ("apertus", NORMED, 194825353691136, 692711652851712),
    ("qwen3_vl", SEEING, 195379819708416, 709446422495232),
]


@pytest.mark.parametrize("family, config, short, long", KNOWN)
def test_flops(spark, family, config, short, long):
    for lengths, want in (([512, 1024, 2048], short), ([4096] * 3, long)):
        df = spark.createDataFrame([(n,) for n in lengths], "seqlen int")
        got = flops.estimate(df, {"model_type": family, **config}, 1.0, device="NVIDIA H100 80GB", images=df).first()
        assert abs(got["achieved"] / (want / 1e12) - 1) < 1e-12 and got["promised"] == 989.0


def test_flops_of_odd_models(spark):
    df = spark.createDataFrame([(None,), (4,)], "seqlen int")
    assert flops.estimate(df, {"model_type": "other"}, 2.0, device="other").first() == (0.0, float("inf"))
    assert flops.estimate(df.limit(0), {"model_type": "llama", **SMALL}, 2.0).first()["achieved"] == 0.0
    assert flops.device_peak("GB200", "P") == 2.5 and flops.device_peak("L40S", "B") == 362.05e12


def test_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.choice([None, "a", "b"])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, w double, v string").withColumn("_part", F.lit(7)).repartition(5)
    want = sorted(rows)
    assert [(r["k"], r["n"]) for r in order.numbered(df, ["k"], "n").orderBy("k").collect()] == [(i, i) for i in range(500)]
    got = order.prefix_sums(df, ["k"], F.col("w"), "s").orderBy("k").collect()
    assert np.allclose([r["s"] for r in got], np.cumsum([0.0] + [r[1] for r in want])[:-1]) and got[0]["_part"] == 7
    last, seen = None, []
    for _, _, v in want:
        last = v if v is not None else last
        seen.append(last)
    assert [r["c"] for r in order.carried(df, ["k"], "v", "c").orderBy("k").collect()] == seen
    for f in (lambda d: order.numbered(d, ["k"], "n"), lambda d: order.prefix_sums(d, ["k"], F.col("w"), "s"), lambda d: order.carried(d, ["k"], "v", "c")):
        assert f(df.limit(0)).count() == 0
    sparse = df.withColumn("v", F.when(F.col("k") == 3, F.lit("x")))
    assert [r["c"] for r in order.carried(sparse, ["k"], "v", "c").orderBy("k").collect()] == [None] * 3 + ["x"] * 497


def test_row_ids_need_no_single_task(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    plan = verbs.with_row_ids(df, ["k"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Python" not in plan


def test_batches_from_columns(spark):
    df = batches.from_columns(spark, {"x": np.arange(6).reshape(3, 2), "y": [1.5, None, 2.5]}, {"name": np.array(["a", "b", None], object)})
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, [0, 1], 1.5, "a"), (1, [2, 3], None, "b"), (2, [4, 5], 2.5, None)]
    assert batches.check_consistent(df) == 3
    for bad in (df.filter("row_id <> 1"), df.unionByName(df), df.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(ValueError):
            batches.check_consistent(bad)
    with pytest.raises(ValueError):
        batches.from_columns(spark, {"x": [1, 2], "y": [1]})
    with pytest.raises(ValueError):
        batches.from_columns(spark, {"x": [1]}, {"x": ["a"]})
    info = {r["name"]: r for r in batches.info(df).collect()}
    assert (info["x"]["bytes"], info["x"]["shortest"], info["x"]["longest"]) == (48, 2, 2)
    assert (info["y"]["bytes"], info["y"]["nulls"], info["name"]["bytes"], info["name"]["nulls"], info["row_id"]["rows"]) == (16, 1, 2, 1, 3)
    made = batches.to_arrays(df, {"step": 4})
    assert made["x"].tolist() == [[0, 1], [2, 3], [4, 5]] and made["step"] == 4
    again, meta = batches.from_message(spark, batches.to_message(df, {"step": "4"}))
    assert meta == {"step": "4"} and verbs.equal(df, again)


def test_messages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(batches, "MAX_BYTES", 100)
    with pytest.raises(ValueError):
        batches.to_message(spark.range(100).withColumnRenamed("id", "row_id"))


def test_plain_values_and_dictionaries():
    assert batches.plain({"a": np.array([[1, 2]]), "b": [np.float64(1.5), {"c": np.int8(3)}]}) == {"a": [[1, 2]], "b": [1.5, {"c": 3}]}
    assert batches.columns_of([{"a": 1, "b": 2}, {"a": 3, "b": 4}]) == {"a": [1, 3], "b": [2, 4]} and batches.columns_of([]) == {}
    with pytest.raises(KeyError):
        batches.columns_of([{"a": 1}, {"b": 1}])
    assert batches.prefixed({"x": 1, "p/y": 2}, "p/") == {"p/x": 1, "p/y": 2}
    assert batches.appended({"p/x": [1]}, {"x": 2, "y": [3, 4]}, "p/") == {"p/x": [1, 2], "p/y": [3, 4]}


def test_group_numbers(spark):
    df = spark.createDataFrame([("b", 5), ("a", 7), (None, 9), ("b", 5)], "s string, n int")
    assert sorted(((r["s"], r["group"]) for r in batches.group_numbers(df, "s").collect()), key=str) == sorted([("b", 2), ("a", 1), (None, 0), ("b", 2)], key=str)
    assert sorted(r["group"] for r in batches.group_numbers(df, "n").collect()) == [5, 5, 7, 9]


def brute_queue(rows, capacity):
    held, produced, consumed, dropped, version, running, out = [], 0, 0, 0, 0, True, []
    for at, op, value, size in sorted(rows):
        accepted, sample = True, None
        if op == "put":
            sample, accepted = value, running
            if running:
                produced += 1
                held.append((value, size))
                if len(held) > capacity:
                    held.pop(0)
                    dropped, accepted = dropped + 1, False
        elif op == "get":
            accepted = bool(held)
            if held:
                sample = held.pop(0)[0]
                consumed += 1
        elif op == "version":
            version = value
        elif op == "clear":
            held = []
        elif op == "close":
            running = False
        elif op != "stats":
            accepted = None
        out.append((at, op, sample, accepted, len(held), produced, consumed, dropped, version, sum(s for _, s in held), running))
    return out


def test_command_queue(spark, tmp_path):
    rng = random.Random(4)
    ops = ["put"] * 6 + ["get"] * 3 + ["version", "clear", "stats", "other"]
    rows = [(0, i, rng.choice(ops) if i < 180 else "close" if i == 180 else rng.choice(["put", "get"]), i * 10, i % 7) for i in range(200)]
    rows += [(1, i, "get", None, None) for i in range(3)]
    spark.createDataFrame(rows, "queue long, at long, op string, value long, bytes long").write.parquet(str(tmp_path / "in"))
    stream = queues.read_stream(spark, str(tmp_path / "in"))
    got = queues.run_to_table(queues.command_queue(stream, 8), "append", "commands")
    for queue in (0, 1):
        mine = [tuple(r)[1:-1] for r in got.filter(F.col("queue") == queue).orderBy("at").collect()]
        assert mine == brute_queue([x[1:] for x in rows if x[0] == queue], 8)


def test_paced(spark):
    rows = [("a", 1, 0.0, 6.0), ("a", 2, 0.0, 6.0), ("a", 3, 0.1, 1.0), ("a", 4, 10.0, 25.0), ("a", 5, 10.0, 1.0), ("b", 1, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "queue string, at int, time double, tokens double")
    got = {(r["queue"], r["at"]): round(r["granted"], 6) for r in queues.paced(df, 10.0).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 0.2, ("a", 3): 0.3, ("a", 4): 11.5, ("a", 5): 11.6, ("b", 1): 3.0}


def test_servers(spark):
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "w"), (6, "y"), (7, None)]
    got = queues.servers(spark.createDataFrame(rows, "at long, request_id string"), 3)
    assert [(r["at"], r["server"]) for r in got.orderBy("at").collect()] == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 0), (6, 1), (7, 1)]


def test_draws_by_hash(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    one = [tuple(r) for r in verbs.sample_rows(df, 10, shuffle=True, seed=3, draw="hash").orderBy("row_id").collect()]
    two = [tuple(r) for r in verbs.sample_rows(df.repartition(7), 10, shuffle=True, seed=3, draw="hash").orderBy("row_id").collect()]
    assert one == two and [r[0] for r in one] == list(range(10)) and len({r[1] for r in one}) == 10 and [r[1] for r in one] != sorted(r[1] for r in one)
    texts = df.select(F.col("x").cast("string").alias("input"))
    assert sinks.sample_generations(texts, 5, draw="hash").count() == 5


def test_batch_of_columns_and_values(spark):
    b = batches.Batch(batches.from_columns(spark, {"x": [1, 2, 3, 4]}), {"step": 1})
    more = b.assign(name=["a", "b", "c", "d"], temperature=0.5)
    assert more.get("name").tolist() == ["a", "b", "c", "d"] and more.get("temperature") == 0.5 and more.get("none", 7) == 7 and b.get("name") is None
    mine, rest = more.pop("x", "step")
    assert mine.frame.columns == ["row_id", "x"] and mine.meta == {"step": 1} and rest.meta == {"temperature": 0.5} and "x" not in rest.frame.columns
    one, two = more.chunks(2)
    assert one.get("x").tolist() == [1, 2] and two.get("name").tolist() == ["c", "d"] and batches.check_consistent(two.frame) == 2
    for bad in (lambda: b.assign(y=[1]), lambda: b.chunks(3)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        b.pop("none")


def test_model_inputs(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 4, 5], 0.5), (2, [1, 2, 3, 4, 5], [6], 1.0), (3, [9], [], 2.0), (4, [9], [8], None)], "row_id long, prompt_ids array<int>, response_ids array<int>, s double")
    got = {r["row_id"]: r for r in layout.model_inputs(df, 3, 2, score=F.col("s"), pad_id=0).collect()}
    assert got[1]["input_ids"] == [0, 1, 2, 3, 4] and got[1]["attention_mask"] == [0, 1, 1, 1, 1] and got[1]["position_ids"] == [0, 0, 1, 2, 3] and got[1]["rm_scores"] == [0.0, 0.5]
    assert got[2]["input_ids"] == [3, 4, 5, 6, 0] and got[2]["rm_scores"] == [1.0, 0.0] and got[2]["response_mask"] == [1, 0]
    assert got[3]["rm_scores"] == [0.0, 0.0] and got[4]["rm_scores"] is None


def test_tools(spark):
    known = {"half": tools.Tool(lambda a: (10 // a["n"], 1), ("n",), "halves")}
    assert tools.answered(known, "half", '{"n": 5}') == ("2", 1.0) and tools.answered(known, "half", '{"n": 0}')[1] == 0.0
    assert tools.answered(known, None, None) == ("no tool None", 0.0) and "JSONDecodeError" in tools.answered(known, "half", "{")[0]
    assert known["half"].schema("half")["function"]["parameters"]["required"] == ["n"]
