"""Queries of batch inspection, training work, queue commands, and of operators that others don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.functions import managers as R
from tallyweave.functions import scoring as S
from tallyweave.functions import tools as U
from tallyweave.operators import balance as B
from tallyweave.operators import batches as H
from tallyweave.operators import evaluation as E
from tallyweave.operators import flops as W
from tallyweave.operators import layout as Y
from tallyweave.operators import metrics as M
from tallyweave.operators import verbs as V
from tallyweave.plans.batch_queries import BATCH, batch
from tallyweave.plans.tables import TOK, query, r6, rollouts, table
from tallyweave.scratch import fresh_path
from tallyweave.sources import datasets as D
from tallyweave.sources import files
from tallyweave.sources import growing as G
from tallyweave.sources import preprocess as P
from tallyweave.sources import sinks as K
from tallyweave.streaming import queues as Q

DENSE = {"model_type": "llama", "vocab_size": 50_000, "hidden_size": 2560, "intermediate_size": 6912, "num_hidden_layers": 20, "num_attention_heads": 20, "num_key_value_heads": 20}
WINDOWS = {"model_type": "gemma3_text", "vocab_size": 100_000, "hidden_size": 2304, "intermediate_size": 9216, "num_hidden_layers": 30, "num_attention_heads": 12, "num_key_value_heads": 6, "head_dim": 192}
EXPERTS = {"model_type": "qwen3_moe", "hidden_size": 1536, "vocab_size": 80_000, "num_hidden_layers": 24, "num_key_value_heads": 4, "num_attention_heads": 24, "head_dim": 96, "moe_intermediate_size": 640, "num_experts_per_tok": 4, "num_experts": 64}


def _sql(body: str) -> str:
    return f"WITH {BATCH} {body}"


# --- training work and balance ------------------------------------------------------------------


@query("training_work", """WITH x AS (SELECT sum(n_chars::DOUBLE) AS n, sum(n_chars::DOUBLE * n_chars) AS sq, sum(n_chars::DOUBLE * least(n_chars, 1024)) AS near FROM documents)
SELECT 'dense' AS model, round((6 * (2.0::DOUBLE * 50000 * 2560 + 20.0::DOUBLE * (3 * 2560 * 6912 + 4 * 2560 * 2560)) * n + 6.0::DOUBLE * 20 * 2560 * sq) / 2 / 1e12, 3) AS achieved, 989.0::DOUBLE AS promised FROM x
UNION ALL SELECT 'windows', round((6 * (2.0::DOUBLE * 100000 * 2304 + 30.0::DOUBLE * (3 * 2304 * 9216 + 2 * 2304 * 192 * 18)) * n + 6.0::DOUBLE * 192 * 12 * (5 * sq + 25 * near)) / 2 / 1e12, 3), 989.0 FROM x
UNION ALL SELECT 'experts', round((6 * (2.0::DOUBLE * 80000 * 1536 + 24.0::DOUBLE * (1536 * (3 * 640 * 4 + 64) + 2 * 1536 * 96 * 28)) * n + 6.0::DOUBLE * 24 * 24 * 96 * sq) / 2 / 1e12, 3), 989.0 FROM x""")  # fmt: skip
def training_work(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = None
    for name, config in (("dense", DENSE), ("windows", WINDOWS), ("experts", EXPERTS)):
        one = W.estimate(d, config, 2.0, length="n_chars", device="NVIDIA H100 80GB").select(F.lit(name).alias("model"), F.round("achieved", 3).alias("achieved"), "promised")
        out = one if out is None else out.unionByName(one)
    return out


# --- batch inspection ---------------------------------------------------------------------------


@query("batch_info", """SELECT 'doc_id' AS name, 'bigint' AS kind, count(*) AS rows, 0::BIGINT AS nulls, 8 * count(*) AS bytes FROM documents
UNION ALL SELECT 'text', 'string', count(*), 0, sum(strlen(text))::BIGINT FROM documents
UNION ALL SELECT 'n_chars', 'bigint', count(*), 0, 8 * count(*) FROM documents""")  # fmt: skip
def batch_info(spark, sf_dir):
    return H.info(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars"))).select("name", "kind", "rows", "nulls", "bytes")


@query("batch_array_info", "SELECT 'embedding' AS name, count(*) AS rows, sum(4 * len(embedding))::BIGINT AS bytes, min(len(embedding))::INTEGER AS shortest, max(len(embedding))::INTEGER AS longest FROM embeddings")
def batch_array_info(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<float>").alias("embedding"))
    return H.info(e).select("name", "rows", "bytes", "shortest", "longest")


@query("batch_consistent", "SELECT count(*) AS rows FROM documents")
def batch_consistent(spark, sf_dir):
    n = H.check_consistent(batch(spark, sf_dir))
    return spark.createDataFrame([(n,)], "rows long")


@query("batch_from_columns", "SELECT n_nationkey AS row_id, n_nationkey, n_name FROM nation")
def batch_from_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # 25 rows
    columns = H.columns_of([r.asDict() for r in rows])
    return H.from_columns(spark, {"n_nationkey": columns["n_nationkey"]}, {"n_name": columns["n_name"]})


@query("batch_message", "SELECT r_regionkey AS row_id, r_name FROM region")
def batch_message(spark, sf_dir):
    """Rows that went through a message and back."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row_id"), "r_name")
    return H.from_message(spark, H.to_message(r, {"step": "1"}))[0]


@query("group_numbers", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS \"group\" FROM orders")
def group_numbers(spark, sf_dir):
    return H.group_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "group")


@query("batch_equal", "SELECT true AS same, false AS other")
def batch_equal(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(V.equal(n, n.repartition(3)), V.equal(n, n.filter("n_nationkey > 0")))], "same boolean, other boolean")


# --- queues ---------------------------------------------------------------------------------------


@query("stream_commands", "SELECT user_id % 3 AS queue, count(*) FILTER (event_id % 5 <> 4) AS produced FROM events GROUP BY user_id % 3")
def stream_commands(spark, sf_dir):
    """Puts and gets of a bounded queue; what each gets is tested against a queue in Python."""
    e = Q.read_stream(spark, f"{sf_dir}/events.parquet")
    c = e.select((F.col("user_id") % 3).alias("queue"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 5 == 4, "get").otherwise("put").alias("op"), F.col("event_id").alias("value"), F.lit(100).cast("long").alias("bytes"))
    got = Q.run_to_table(Q.command_queue(c, 64), "append", "commands")
    return got.groupBy("queue").agg(F.max("produced").alias("produced"))


@query("paced_requests", "SELECT user_id AS queue, count(*) AS requests, round(least(greatest(0, (count(*) - 4) / 2), 1e9), 6) AS last FROM events GROUP BY user_id")
def paced_requests(spark, sf_dir):
    """Requests that all come at time 0, of one token each, to buckets of 4 that gain 2 a second."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("at"), F.lit(0.0).alias("time"), F.lit(1.0).alias("tokens"))
    got = Q.paced(e, 2.0, 4.0).groupBy("queue").agg(F.count("*").alias("requests"), F.max("granted").alias("last"))
    return got.select("queue", "requests", r6("last", "last"))


@query("chosen_servers", "WITH f AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY user_id) SELECT user_id, CAST((row_number() OVER (ORDER BY f, user_id) - 1) % 4 AS INTEGER) AS server FROM f")
def chosen_servers(spark, sf_dir):
    return Q.servers(table(spark, sf_dir, "events").select("event_id", "user_id"), 4, request="user_id", at="event_id").select("user_id", "server").distinct()


# --- metrics and latest rows -----------------------------------------------------------------------


@query("latest_rows", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_rows(spark, sf_dir):
    return M.latest_first(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("response_lengths", f"WITH {TOK} SELECT row_id, sum(m)::DOUBLE AS response_length, 4.0::DOUBLE AS prompt_length FROM tok GROUP BY row_id")
def response_lengths(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    r = r.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), 4), F.col("mask")))
    return M.response_lengths(r).select("row_id", "response_length", "prompt_length")


@query("derived_metrics", """WITH d AS (SELECT max(n_chars)::DOUBLE AS hi, min(n_chars)::DOUBLE AS lo, sum(n_chars)::DOUBLE AS n FROM documents),
e AS (SELECT sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS gen, sum(value) AS step FROM events WHERE value IS NOT NULL)
SELECT 'global_seqlen/max' AS name, hi AS value FROM d UNION ALL SELECT 'global_seqlen/min', lo FROM d UNION ALL SELECT 'global_seqlen/minmax_diff', hi - lo FROM d
UNION ALL SELECT 'perf/total_num_tokens', n FROM d UNION ALL SELECT 'perf/time_per_step', round(step, 3) FROM e UNION ALL SELECT 'perf/throughput', round(n / (round(step, 3) * 8), 6) FROM d, e
UNION ALL SELECT 'timing_s/gen', round(gen, 3) FROM e UNION ALL SELECT 'timing_s/step', round(step, 3) FROM e UNION ALL SELECT 'trainer/idle_ratio', round(round(gen, 3) / round(step, 3), 6) FROM e""")  # fmt: skip
def derived_metrics(spark, sf_dir):
    """Metrics of documents and events, with stale spreads and throughputs that are worked out anew."""
    d = table(spark, sf_dir, "documents").agg(F.max("n_chars").cast("double").alias("hi"), F.min("n_chars").cast("double").alias("lo"), F.sum("n_chars").cast("double").alias("n"))
    e = table(spark, sf_dir, "events").filter("value is not null")
    e = e.agg(F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0)), 3).alias("gen"), F.round(F.sum("value"), 3).alias("step"))
    named = {"global_seqlen/max": "hi", "global_seqlen/min": "lo", "perf/total_num_tokens": "n", "timing_s/gen": "gen", "timing_s/step": "step", "perf/time_per_step": "step"}
    pairs = [F.struct(F.lit(k).alias("name"), F.col(v).alias("value")) for k, v in named.items()] + [F.struct(F.lit(k).alias("name"), F.lit(-1.0).alias("value")) for k in ("global_seqlen/minmax_diff", "perf/throughput")]
    metrics = d.crossJoin(e).select(F.inline(F.array(*pairs)))  # one row each
    return M.derived_metrics(metrics, 8).select("name", r6("value", "value"))


@query("model_inputs", f"""WITH {TOK}, n AS (SELECT row_id, count(*) AS n, sum(r) AS s FROM tok GROUP BY row_id)
SELECT row_id, 10 AS width, least(n, 6) + 3 AS seen, (least(n, 6) + 2)::INTEGER AS last, round(s, 6) AS score FROM n""")  # fmt: skip
def model_inputs(spark, sf_dir):
    """Prompts of three tokens in four places, responses cut to six."""
    r = rollouts(spark, sf_dir, "rewards").withColumn("prompt_ids", F.array(F.lit(7), F.lit(8), F.lit(9))).withColumn("response_ids", F.transform("rewards", lambda _, i: i + 1))
    got = Y.model_inputs(r, 4, 6, score=A.array_sum("rewards"))
    return got.select("row_id", F.size("input_ids").alias("width"), A.array_sum("attention_mask").cast("long").alias("seen"), F.array_max("position_ids").alias("last"), r6(A.array_sum("rm_scores"), "score"))


@query("tool_results", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'twice ' || (2 * item_id) WHEN item_id % 3 = 1 THEN 'arguments missing: n' ELSE 'no tool ''other''' END AS text,
CASE WHEN item_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM benchmark""")  # fmt: skip
def tool_results(spark, sf_dir):
    """Calls in a response, parsed and run."""
    k = F.col("item_id")
    call = F.when(k % 3 == 0, F.format_string('{"name": "twice", "arguments": {"n": %d}}', k)).when(k % 3 == 1, '{"name": "twice", "arguments": {}}').otherwise('{"name": "other", "arguments": {}}')
    b = table(spark, sf_dir, "benchmark").select("item_id", S.tool_calls(F.concat(F.lit("so <tool_call>"), call, F.lit("</tool_call>"))).alias("c"))
    twice = U.Tool(lambda a: (f"twice {2 * a['n']}", 1.0), required=("n",))
    return b.select("item_id", U.run_calls("c.calls", {"twice": twice})[0].alias("x")).select("item_id", "x.text", "x.reward")


@query("interactions", "SELECT item_id, item_id % 2 = 0 AS done, CASE WHEN item_id % 2 = 0 THEN 'right' ELSE 'try again' END AS text, (item_id % 2 = 0)::INT::DOUBLE AS reward FROM benchmark")
def interactions(spark, sf_dir):
    """An interaction that ends a chat once its last turn is the truth."""
    k = F.col("item_id")
    chat = F.array(P.message("user", F.lit("?")), P.message("assistant", F.when(k % 2 == 0, k.cast("string")).otherwise("no")))
    said = lambda chat, truth: (True, "right", 1.0) if chat[-1]["content"] == truth else (False, "try again", 0.0)
    return table(spark, sf_dir, "benchmark").select("item_id", U.next_turn(chat, k.cast("string"), said).alias("x")).select("item_id", "x.done", "x.text", "x.reward")


@query("matched_answers", "SELECT item_id, item_id % 2 = 0 AS boxed, CAST(item_id AS VARCHAR) AS answer, true AS good FROM benchmark")
def matched_answers(spark, sf_dir):
    """The answer that a response gives, boxed or after its last cue, and whether it equals the truth."""
    k = F.col("item_id").cast("string")
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("so \\boxed{"), k, F.lit("}"))).otherwise(F.concat(F.lit("The answer is "), k, F.lit(".")))
    got = table(spark, sf_dir, "benchmark").select("item_id", S.graded_column(text, k).alias("g"))
    return got.select("item_id", "g.boxed", "g.answer", F.col("g.good").alias("good"))


@query("balanced_runs", "SELECT count(DISTINCT o_orderkey // 64) AS runs FROM orders")
def balanced_runs(spark, sf_dir):
    """Runs of orders dealt to parts whole: as many (run, part) pairs as runs. Runs that don't divide evenly are filled up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_orderkey") / 64).alias("uid"), F.lit(10).cast("long").alias("seqlen"))
    runs = o.select("uid").distinct().count()
    filler = spark.range(-runs % 4).select((-F.col("id") - 1).alias("row_id"), (-F.col("id") - 1).alias("uid"), F.lit(1).cast("long").alias("seqlen"))
    got = B.assign(o.unionByName(filler), 4, uid="uid")
    return got.filter("row_id >= 0").select("uid", "part").distinct().agg(F.count("*").alias("runs"))


# --- texts and scores ---------------------------------------------------------------------------------


@query("search_questions", "SELECT 'searchR1_' || lang AS data_source, 'find: ' || doc_id AS question, '[\"' || lang || '\"]' AS truth FROM documents")
def search_questions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("question"), F.col("lang").alias("data_source"), F.array("lang").alias("golden_answers"))
    target = F.lit(None).cast("struct<ground_truth: struct<target: array<string>>>")
    got = P.search_questions(d.withColumn("reward_model", target), "train", "answer", "find: ")
    return got.select("data_source", F.element_at("prompt", 2)["content"].alias("question"), F.col("reward_model.ground_truth").alias("truth"))


@query("chat_pairs", "SELECT o_orderkey AS prompt, unnest([o_orderstatus, o_orderpriority]) AS response FROM orders")
def chat_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return P.chat_pairs(o.select(F.col("o_orderkey").alias("prompt"), F.col("o_orderstatus").alias("chosen"), F.col("o_orderpriority").alias("rejected")))


@query("chat_prompts", "SELECT o_orderpriority AS content, o_orderstatus AS truth, CAST(o_orderkey AS VARCHAR) AS index FROM orders")
def chat_prompts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("prompt"), F.col("o_orderstatus").alias("chosen"))
    got = P.chat_prompts(o, "train", "own")
    return got.select(F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.element_at("extra_info", "index").alias("index"))


@query("image_questions", "SELECT CAST(item_id AS VARCHAR) AS index, text AS question, CAST(item_id % 7 AS VARCHAR) AS truth, 2 AS images FROM benchmark")
def image_questions(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("problem"), (F.col("item_id") % 7).cast("string").alias("answer"), F.array(F.lit(b"a"), F.lit(b"b")).alias("images"))
    got = P.image_questions(b, "train")
    return got.select(F.element_at("extra_info", "index").alias("index"), F.element_at("extra_info", "question").alias("question"), F.col("reward_model.ground_truth").alias("truth"), F.size("images").alias("images"))


@query("spoken_turns", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def spoken_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.when(F.col("role") == "assistant", "gpt").otherwise("human").alias("from"), F.col("text").alias("value"))
    made = P.spoken_turns(c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("conversations")))
    return made.select("conv_id", F.size("messages").cast("long").alias("turns"), F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("long").alias("answers"))


@query("evaluation_scores", "SELECT 'test_score/' || o_orderpriority AS name, round(avg(((o_orderstatus = 'F')::INT + 1) / 2.0::DOUBLE), 6) AS value FROM orders GROUP BY o_orderpriority")
def evaluation_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("data_source"), F.array("o_orderstatus", F.lit("F")).alias("responses"), F.lit("F").alias("truth"))
    got = E.evaluate(o, lambda source, response, truth: (response == truth).cast("double"), truth="truth")
    return got.select("name", r6("value", "value"))


@query("dataset_resumed", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_id, item_id FROM benchmark")
def dataset_resumed(spark, sf_dir):
    """A dataset made again from its state as text, its files copied first."""
    file = files.copied(spark, f"{sf_dir}/benchmark.parquet", fresh_path(spark, "copies"))
    state = files.DatasetState.of(file, ["item_id"]).to_json()
    return files.DatasetState.from_json(state).resume(spark).select("row_id", "item_id")


@query("retrieved_passages", "SELECT item_id, 'Doc 1 (Title: first ' || item_id || ')' || chr(10) || 'line' || chr(10) || chr(10) || 'Doc 2 (Title: second)' AS shown FROM benchmark")
def retrieved_passages(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    one = F.struct(F.concat(F.lit("first "), F.col("item_id").cast("string"), F.lit("\nline")).alias("contents"))
    return b.select("item_id", S.passages(F.array(one, F.struct(F.lit("second").alias("contents")))).alias("shown"))


@query("same_outputs", "SELECT item_id, item_id % 2 = 0 AS same FROM benchmark")
def same_outputs(spark, sf_dir):
    k = F.col("item_id").cast("string")
    other = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a \n "), k, F.lit("\n"))).otherwise(F.concat(F.lit("b\n"), k))
    return table(spark, sf_dir, "benchmark").select("item_id", S.same_output(F.concat(F.lit(" a\n"), k), other).alias("same"))


@query("expression_forms", """SELECT o_orderkey, o_orderkey % 3 <> 0 AS simple, '2*' || '3.14*x' AS pi FROM orders""")
def expression_forms(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "a+b+c").otherwise("\\frac{a}{b}+\\sqrt{a}")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.may_evaluate(text).alias("simple"), S.with_pi(F.lit("2\\pi*x"), 3.14).alias("pi"))


@query("stripped_padding", f"WITH {TOK} SELECT row_id, count(*) FILTER (m <> 0) AS kept, round(coalesce(sum(r) FILTER (m <> 0), 0), 6) AS total FROM tok GROUP BY row_id")
def stripped_padding(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("kept", A.strip_padding("rewards", "mask"))
    return r.select("row_id", F.size("kept").cast("long").alias("kept"), r6(A.array_sum("kept"), "total"))


@query("manager_naive", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS total FROM orders")
def manager_naive(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit(1), F.lit(1)).alias("mask"), (F.col("o_orderstatus") == "F").cast("double").alias("s"))
    return R.scored(o, "naive", F.col("s")).select("o_orderkey", A.array_sum("token_scores").alias("total"))


# --- balance -------------------------------------------------------------------------------------------


@query("greedy_parts", _sql(", s AS (SELECT sum(n_chars) AS total, max(n_chars) AS most FROM documents) SELECT total::BIGINT AS total, true AS close FROM s"))
def greedy_parts(spark, sf_dir):
    """Sums of a greedy partition of all documents; the spread is at most the longest document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("seqlen"))
    got = B.assign(d, 8, how="greedy").groupBy("part").agg(F.sum("seqlen").alias("s"))
    most = d.agg(F.max("seqlen").alias("m"))
    return got.agg(F.sum("s").alias("total"), (F.max("s") - F.min("s")).alias("gap")).crossJoin(most).select("total", (F.col("gap") <= F.col("m")).alias("close"))  # one row each


# --- sinks and growing datasets -----------------------------------------------------------------------


@query("sink_rollout_log", f"WITH {TOK} SELECT data_source AS input, pred AS output, uid::VARCHAR AS gts, round(sum(r), 6) AS score FROM tok GROUP BY row_id, data_source, pred, uid")
def sink_rollout_log(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("ground_truth", F.col("uid").cast("string"))
    return K.rollout_log(r, "data_source", "pred", "rewards").select("input", "output", "gts", r6("score", "score"))


@query("growing_stream", "SELECT event_id, value * 2 AS value FROM events WHERE value IS NOT NULL")
def growing_stream(spark, sf_dir):
    """Rows that a generator makes of every micro-batch, appended to a table."""
    path = fresh_path(spark, "grown")
    stream = Q.read_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "value")
    writer = G.on_batch(stream, path, lambda b: b.filter("value is not null").withColumn("value", F.col("value") * 2))
    writer.option("checkpointLocation", fresh_path(spark, "grown-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "value")


@query("dataset_numbered_prompts", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_id, item_id FROM benchmark")
def dataset_numbered_prompts(spark, sf_dir):
    return D.prompts(spark, f"{sf_dir}/benchmark.parquet", ["item_id"]).select("row_id", "item_id")
