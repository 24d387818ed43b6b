"""Queries of positional verbs, metrics, balancing and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays as A
from tallyweave.operators import balance as B
from tallyweave.operators import metrics as M
from tallyweave.operators import verbs as V
from tallyweave.plans.tables import TOK, query, r6, rollouts, table
from tallyweave.streaming import queues as Q
from tallyweave.streaming import windows as W

#: Documents numbered from 0 in order of doc_id.
BATCH = "b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, n_chars, lang FROM documents), n AS (SELECT count(*) AS n FROM documents)"


def batch(spark, sf_dir) -> DataFrame:
    return V.with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), ["doc_id"])


def _sql(body: str) -> str:
    return f"WITH {BATCH} {body}"


@query("verb_select_rename", _sql("SELECT row_id, n_chars AS size FROM b"))
def verb_select_rename(spark, sf_dir):
    return V.rename(V.select(batch(spark, sf_dir), ["n_chars"], optional=["absent"]), ["n_chars"], ["size"])


@query("verb_pop", _sql("SELECT row_id, doc_id, n_chars FROM b"))
def verb_pop(spark, sf_dir):
    return V.pop(batch(spark, sf_dir), ["lang"])[1]


@query("verb_gather", _sql("SELECT i AS row_id, doc_id, n_chars, lang FROM (SELECT unnest(range(0, 50)) AS i) JOIN b ON b.row_id = (i * 7) % 60"))
def verb_gather(spark, sf_dir):
    return V.gather(batch(spark, sf_dir), [i * 7 % 60 for i in range(50)])


@query("verb_where", _sql("SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, doc_id, n_chars, lang FROM b WHERE lang = 'de'"))
def verb_where(spark, sf_dir):
    return V.where(batch(spark, sf_dir), F.col("lang") == "de")


@query("verb_slice", _sql("SELECT (n - 3 - row_id) // 5 AS row_id, doc_id, n_chars, lang FROM b, n WHERE row_id > 10 AND row_id <= n - 3 AND (n - 3 - row_id) % 5 = 0"))
def verb_slice(spark, sf_dir):
    return V.slice_rows(batch(spark, sf_dir), -3, 10, -5)


@query("verb_repeat_interleave", _sql("SELECT row_id * 3 + k AS row_id, doc_id, n_chars, lang FROM b, (SELECT unnest(range(0, 3)) AS k)"))
def verb_repeat_interleave(spark, sf_dir):
    return V.repeat(batch(spark, sf_dir), 3)


@query("verb_repeat_tile", _sql("SELECT k * n + row_id AS row_id, doc_id, n_chars, lang FROM b, n, (SELECT unnest(range(0, 2)) AS k)"))
def verb_repeat_tile(spark, sf_dir):
    return V.repeat(batch(spark, sf_dir), 2, interleave=False)


@query("verb_repeat_each", _sql("SELECT row_number() OVER (ORDER BY row_id, k) - 1 AS row_id, doc_id, n_chars, lang FROM (SELECT *, unnest(range(0, doc_id % 4)) AS k FROM b)"))
def verb_repeat_each(spark, sf_dir):
    return V.repeat_each(batch(spark, sf_dir), F.col("doc_id") % 4)


@query("verb_unfold", "SELECT vec_id * 4 + k AS row_id, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::DOUBLE)), 6) + 0.0 AS total, label FROM embeddings, (SELECT unnest(range(0, 4)) AS k)")
def verb_unfold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    return V.unfold(e, 4, ["embedding"]).select("row_id", r6(A.array_sum("embedding"), "total"), "label")


@query("verb_fold", _sql("SELECT row_id // 4 AS row_id, string_agg(doc_id, ',' ORDER BY row_id) AS ids, count(*) AS n FROM b GROUP BY row_id // 4"))
def verb_fold(spark, sf_dir):
    return V.fold(batch(spark, sf_dir), 4).select("row_id", F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("ids"), F.size("doc_id").cast("long").alias("n"))


@query("verb_padding", _sql("SELECT row_id, doc_id, n_chars, lang FROM b UNION ALL SELECT n + k, doc_id, n_chars, lang FROM b, n, (SELECT unnest(range(0, 3)) AS k) WHERE row_id = n - 1"))
def verb_padding(spark, sf_dir):
    return V.padding(batch(spark, sf_dir), 3)


@query("verb_pad_to_divisor", _sql("SELECT row_id, doc_id, n_chars, lang FROM b UNION ALL SELECT n + row_id, doc_id, n_chars, lang FROM b, n WHERE row_id < (7 - n % 7) % 7"))
def verb_pad_to_divisor(spark, sf_dir):
    return V.pad_to_divisor(batch(spark, sf_dir), 7)[0]


@query("verb_unpad", _sql("SELECT row_id, doc_id, n_chars, lang FROM b, n WHERE row_id < n - 5"))
def verb_unpad(spark, sf_dir):
    return V.unpad(batch(spark, sf_dir), 5)


@query("verb_chunk", _sql("SELECT CAST(row_id // CAST(ceil(n / 7) AS BIGINT) AS INTEGER) AS part, count(*) AS rows, min(doc_id) AS first FROM b, n GROUP BY 1"))
def verb_chunk(spark, sf_dir):
    return V.chunk(batch(spark, sf_dir), 7, pad=True).groupBy("part").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))


@query("verb_split", _sql("SELECT CAST(row_id // 64 AS INTEGER) AS part, count(*) AS rows FROM b GROUP BY 1"))
def verb_split(spark, sf_dir):
    return V.split(batch(spark, sf_dir), 64).groupBy("part").agg(F.count("*").alias("rows"))


@query("verb_batches", _sql("SELECT epoch, CAST(row_id // 20 AS INTEGER) AS batch, sum(doc_id)::BIGINT AS ids FROM (SELECT *, unnest([0, 1]) AS epoch FROM b) GROUP BY 1, 2"))
def verb_batches(spark, sf_dir):
    return V.batches(batch(spark, sf_dir), 20, 2, short=True).groupBy("epoch", "batch").agg(F.sum("doc_id").alias("ids"))


@query("verb_batches_shuffled")
def verb_batches_shuffled(spark, sf_dir):
    """Seeded mini-batches; which rows meet follows a hash, tested by invariants."""
    return V.batches(batch(spark, sf_dir), 20, 2, seed=3, short=True).select("row_id", "epoch", "batch")


@query("verb_union", _sql("SELECT row_id, doc_id, n_chars, lang, n_chars * 2 AS twice FROM b"))
def verb_union(spark, sf_dir):
    left = batch(spark, sf_dir)
    return V.union(left, left.select("row_id", "lang", (F.col("n_chars") * 2).alias("twice")))


@query("verb_concat", _sql("SELECT row_id, doc_id, n_chars, lang FROM b UNION ALL SELECT (SELECT count(*) FROM b) + row_id, doc_id, n_chars, lang FROM b"))
def verb_concat(spark, sf_dir):
    b = batch(spark, sf_dir)
    return V.concat([b, b])


@query("verb_transitions", "SELECT event_id, user_id, value AS current_value, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), value) AS next_value FROM events")
def verb_transitions(spark, sf_dir):
    return V.transitions(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["value"], "user_id", "event_id")


@query("sample_first", _sql("SELECT row_id, doc_id, n_chars, lang FROM b WHERE row_id < 25"))
def sample_first(spark, sf_dir):
    return V.sample_rows(batch(spark, sf_dir), 25)


@query("sample_seeded")
def sample_seeded(spark, sf_dir):
    """numpy's seeded choice without replacement; tested against numpy."""
    return V.sample_rows(batch(spark, sf_dir), 25, shuffle=True, seed=1)


@query("data_metrics", f"""WITH {TOK}, p AS (SELECT row_id, sum(r) AS s, sum(r - 0.1::DOUBLE * v) AS w, sum(m)::DOUBLE AS n FROM tok GROUP BY row_id),
x AS (SELECT avg(s) FILTER (n > 0) AS a1, max(s) FILTER (n > 0) AS a2, min(s) FILTER (n > 0) AS a3, avg(w) FILTER (n > 0) AS b1, max(w) FILTER (n > 0) AS b2, min(w) FILTER (n > 0) AS b3, avg(n) AS c1, max(n) AS c2, min(n) AS c3, avg((n = 9)::INT) AS clip, avg((n = 0)::INT) AS ab FROM p),
y AS (SELECT avg(r - v) AS d1, avg(r + v) AS e1, avg(v) AS f1, 1 - var_samp(r) / (var_samp(r + v) + 1e-5) AS ev FROM tok WHERE m = 1)
SELECT round(a1, 6) AS score_mean, round(a2, 6) AS score_max, round(a3, 6) AS score_min, round(b1, 6) + 0.0 AS reward_mean, round(b2, 6) + 0.0 AS reward_max, round(b3, 6) + 0.0 AS reward_min, round(c1, 6) AS response_length_mean, round(c2, 6) AS response_length_max, round(c3, 6) AS response_length_min,
round(clip, 6) AS response_clip_ratio, round(ab, 6) AS aborted_ratio, round(d1, 6) + 0.0 AS advantages_mean, round(e1, 6) AS returns_mean, round(f1, 6) AS values_mean, round(ev, 6) + 0.0 AS vf_explained_var FROM x, y""")  # fmt: skip
def data_metrics(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("scores", F.col("rewards")).withColumn("prompt_length", F.lit(4.0))
    made = made.withColumn("advantages", F.zip_with("rewards", "values", lambda r, v: r - v)).withColumn("returns", F.zip_with("rewards", "values", lambda r, v: r + v))
    made = made.withColumn("rewards", F.zip_with("rewards", "values", lambda r, v: r - 0.1 * v))
    got = M.data_metrics(made, max_response=9, max_prompt=8)
    names = ["score_mean", "score_max", "score_min", "reward_mean", "reward_max", "reward_min", "response_length_mean", "response_length_max", "response_length_min", "response_clip_ratio", "aborted_ratio", "advantages_mean", "returns_mean", "values_mean", "vf_explained_var"]
    return got.select(*[r6(c, c) for c in names])


@query("timing_metrics", f"""WITH {TOK}, t AS (SELECT sum(m) AS r, sum(m) + 4 * count(DISTINCT row_id) AS a FROM tok), p(phase, s) AS (VALUES ('gen', 2.5::DOUBLE), ('ref', 1.25::DOUBLE))
SELECT 'timing_s/' || phase AS name, s AS value FROM p UNION ALL SELECT 'timing_per_token_ms/' || phase, round(s * 1000 / CASE WHEN phase = 'gen' THEN r ELSE a END, 6) FROM p, t""")  # fmt: skip
def timing_metrics(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("prompt_length", F.lit(4.0))
    return M.timing_metrics(made, {"gen": 2.5, "ref": 1.25}).select("name", r6("value", "value"))


@query("throughput_metrics", f"WITH {TOK} SELECT round(sum(m) + 4 * count(DISTINCT row_id), 6) AS tokens, 3.0::DOUBLE AS seconds, round((sum(m) + 4 * count(DISTINCT row_id)) / 24, 6) AS throughput FROM tok")
def throughput_metrics(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("prompt_length", F.lit(4.0))
    return M.throughput_metrics(made, 3.0, 8).select(r6("tokens", "tokens"), "seconds", r6("throughput", "throughput"))


@query("variance_proxies", f"""WITH {TOK}, x AS (SELECT 1 - 2 * exp(olp) + spi AS w, r - v AS a FROM tok WHERE m = 1), p AS (SELECT avg(a * a * greatest(w, 0)) AS p2, avg(w) AS w FROM x), n AS (SELECT count(DISTINCT row_id) AS n FROM tok)
SELECT 0.0025::DOUBLE AS proxy1, round(p2, 6) AS proxy2, round(greatest(0, (p2 - 0.0025::DOUBLE) / (n - 1)), 6) + 0.0 AS proxy3, round(w, 6) AS w_mean FROM p, n""")  # fmt: skip
def variance_proxies(spark, sf_dir):
    made = rollouts(spark, sf_dir).withColumn("advantages", F.zip_with("rewards", "values", lambda r, v: r - v))
    got = M.variance_proxies(made, 0.05)
    return got.select(*[r6(c, c) for c in got.columns])


@query("probability_gap", f"WITH {TOK}, x AS (SELECT exp(rlp) AS a, exp(olp) AS b, abs(exp(rlp) - exp(olp)) AS d FROM tok WHERE m = 1) SELECT round(max(d), 6) AS diff_max, round(avg(d), 6) AS diff_mean, round(stddev_samp(d), 6) AS diff_std, round(corr(a, b), 6) AS pearson FROM x")
def probability_gap(spark, sf_dir):
    got = M.probability_gap(rollouts(spark, sf_dir))
    return got.select(*[r6(c, c) for c in got.columns])


@query("token_differences", f"WITH {TOK} SELECT row_id, CAST(sum((m <> 0 AND r <> v)::INT) AS BIGINT) AS differ FROM tok GROUP BY row_id")
def token_differences(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", M.token_differences("rewards", "values").alias("differ"))


METRICS = "mt AS (SELECT event_id AS step, CASE user_id % 6 WHEN 0 THEN 'score/max' WHEN 1 THEN 'length/min' WHEN 2 THEN 'reward/mean' WHEN 3 THEN 'timing_s/gen' WHEN 4 THEN 'training/global_step' ELSE 'tokens/total' END AS name, value, event_id % 5 + 1 AS sample_count FROM events WHERE value IS NOT NULL)"


def metric_stream(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    names = ["score/max", "length/min", "reward/mean", "timing_s/gen", "training/global_step"]
    name = F.lit("tokens/total")
    for i, n in enumerate(names):
        name = F.when(F.col("user_id") % 6 == i, n).otherwise(name)
    return e.select(F.col("event_id").alias("step"), name.alias("name"), "value", (F.col("event_id") % 5 + 1).alias("sample_count"))


@query("reduce_metrics", f"WITH {METRICS} SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM mt GROUP BY name")
def reduce_metrics(spark, sf_dir):
    return M.reduce_metrics(metric_stream(spark, sf_dir)).select("name", r6("value", "value"))


@query("aggregate_metric_stream", f"""WITH {METRICS}, r AS (SELECT *, CASE name WHEN 'training/global_step' THEN 'last' WHEN 'timing_s/gen' THEN 'sum' WHEN 'reward/mean' THEN 'avg' WHEN 'score/max' THEN 'max' WHEN 'length/min' THEN 'min' ELSE 'sum' END AS rule FROM mt)
SELECT name, rule, round(CASE rule WHEN 'last' THEN arg_max(value, step) WHEN 'sum' THEN sum(value) WHEN 'avg' THEN avg(value) WHEN 'max' THEN max(value) ELSE min(value) END, 4) AS value FROM r GROUP BY name, rule""")  # fmt: skip
def aggregate_metric_stream(spark, sf_dir):
    return M.aggregate_stream(metric_stream(spark, sf_dir)).select("name", "rule", F.round("value", 4).alias("value"))


@query("reduce_ranks", f"WITH {METRICS}, p AS (SELECT name, step // 4 AS pos, avg(value) AS v FROM mt GROUP BY 1, 2) SELECT name, round(sum(v), 4) AS value FROM p GROUP BY name")
def reduce_ranks(spark, sf_dir):
    made = metric_stream(spark, sf_dir).select("name", F.floor(F.col("step") / 4).alias("pos"), (F.col("step") % 4).alias("rank"), "value")
    return M.reduce_ranks(made, "sum").select("name", F.round("value", 4).alias("value"))


@query("sample_summary", "SELECT round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def sample_summary(spark, sf_dir):
    got = M.sample_summary(table(spark, sf_dir, "events"), "value")
    return got.select(*[r6(c, c) for c in got.columns])


@query("version_span", "WITH v AS (SELECT user_id % 7 AS s, user_id % 7 + event_id % 3 AS e FROM events) SELECT round(avg((e <> s)::INT), 6) AS partial_ratio, max(e - s) AS max_span, count(DISTINCT e) AS versions FROM v")
def version_span(spark, sf_dir):
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("version_start"), (F.col("user_id") % 7 + F.col("event_id") % 3).alias("version_end"))
    return M.version_span(v).select(r6("partial_ratio", "partial_ratio"), "max_span", "versions")


@query("loop_performance", """WITH p AS (SELECT event_id AS row_id, value AS g, value * (event_id % 3) AS t FROM events WHERE value IS NOT NULL), s AS (SELECT * FROM p ORDER BY g + t DESC, row_id LIMIT 1)
SELECT round(min(p.g), 6) AS generate_min, round(max(p.g), 6) AS generate_max, round(avg(p.g), 6) AS generate_mean, round(min(p.t), 6) AS tool_min, round(max(p.t), 6) AS tool_max, round(avg(p.t), 6) AS tool_mean, any_value(s.row_id) AS slowest_row FROM p, s""")  # fmt: skip
def loop_performance(spark, sf_dir):
    p = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_id").alias("row_id"), F.col("value").alias("generate_s"), (F.col("value") * (F.col("event_id") % 3)).alias("tool_s"))
    got = M.loop_performance(p)
    return got.select(*[r6(c, c) for c in got.columns if c.split("_")[0] in ("generate", "tool")], "slowest_row")


@query("rate_schedules", """WITH s AS (SELECT event_id, event_id % 1000 AS step FROM events) SELECT event_id, round(CASE WHEN step < 100 THEN step / 100 ELSE greatest(0, (cos(pi() * (step - 100) / 900) + 1) * 0.5 * 0.9 + 0.1) END, 6) AS cosine,
round(CASE WHEN step < 100 THEN step / 100 ELSE 1 END, 6) AS constant, round(CASE WHEN step < 100 THEN 0.2 + 0.8 * step / 100 WHEN step < 820 THEN 1 ELSE 0.8 * greatest(0, 0.5 * (1 + cos(pi() * (step - 820) / 180))) + 0.2 END, 6) AS held FROM s""")  # fmt: skip
def rate_schedules(spark, sf_dir):
    """Rates at each event, a step of a run of 1000."""
    steps = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(1000)).alias("step"))
    one = M.schedule(steps, "cosine", 100, 1000, floor=0.1).withColumnRenamed("rate", "c")
    two = M.schedule(one, "constant", 100, 1000).withColumnRenamed("rate", "k")
    three = M.schedule(two, "wsd", 100, 1000, floor=0.2, stable=0.8)
    return three.select("event_id", r6("c", "cosine"), r6("k", "constant"), r6("rate", "held"))


@query("workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS work FROM documents")
def workload(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.workload(F.col("n_chars")).alias("work"))


@query("balanced_parts")
def balanced_parts(spark, sf_dir):
    """Largest differencing over all conversations' lengths; any number of them, so parts of equal sums, not counts; tested in Python."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("seqlen"))
    return B.assign(c.withColumnRenamed("conv_id", "row_id"), 8)


@query("balance_report")
def balance_report(spark, sf_dir):
    """Sums of lengths over parts before and after balancing; tested in Python."""
    return B.imbalance(balanced_parts(spark, sf_dir), 8)


@query("stream_bounded_queue", """WITH q AS (SELECT user_id % 4 AS queue, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id % 4) AS n FROM events)
SELECT queue, any_value(n) AS produced, greatest(any_value(n) - 50, 0) AS dropped, count(*) AS size, min(event_id) AS oldest, max(event_id) AS newest FROM q WHERE k <= 50 GROUP BY queue""")  # fmt: skip
def stream_bounded_queue(spark, sf_dir):
    stream = Q.read_stream(spark, f"{sf_dir}/events.parquet").select((F.col("user_id") % 4).alias("queue"), F.col("event_id").alias("sample_id"))
    return Q.latest(Q.run_to_table(Q.bounded_queue(stream, 50), "update", "queue"), "queue")


@query("stream_count_windows", """WITH q AS (SELECT user_id % 4 AS queue, event_id, value, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS k FROM events WHERE value IS NOT NULL)
SELECT queue, k // 32 AS window, min(event_id) AS first, max(event_id) AS last, round(sum(value), 4) AS total, count(*) AS samples FROM q GROUP BY 1, 2 HAVING count(*) = 32""")  # fmt: skip
def stream_count_windows(spark, sf_dir):
    stream = Q.read_stream(spark, f"{sf_dir}/events.parquet").filter("value is not null").select((F.col("user_id") % 4).alias("queue"), F.col("event_id").alias("sample_id"), "value")
    got = Q.run_to_table(Q.count_windows(stream, 32), "append", "windows")
    return got.select("queue", "window", "first", "last", F.round("total", 4).alias("total"), "samples")


@query("stream_staleness", """WITH v AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), s AS (SELECT count(*) AS samples, coalesce(sum((10 - k > 4)::INT), 0)::BIGINT AS stale FROM v)
SELECT samples, stale, round(stale / samples, 6) AS stale_ratio FROM s""")  # fmt: skip
def stream_staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return Q.staleness(e, "k", 10, 4).select("samples", "stale", r6("stale_ratio", "stale_ratio"))


@query("ring_buffer", "WITH r AS (SELECT event_id, user_id, event_id % 128 AS slot, row_number() OVER (PARTITION BY event_id % 128 ORDER BY event_id DESC) AS k FROM events) SELECT event_id, user_id, slot FROM r WHERE k = 1")
def ring_buffer(spark, sf_dir):
    return Q.ring(table(spark, sf_dir, "events").select("event_id", "user_id"), 128, "event_id")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_windows(spark, sf_dir):
    got = W.tumbling(table(spark, sf_dir, "events"), "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), keys=("event_type",))
    return got


@query("stream_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_windows(spark, sf_dir):
    got = Q.run_to_table(W.tumbling(Q.read_stream(spark, f"{sf_dir}/events.parquet"), "1 day", F.count("*").alias("n"), late="3650 days"), "update", "tumbling")
    return got.groupBy("window_start", "window_end").agg(F.max_by("n", "batch").alias("n"))


@query("sliding_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS window_start, value FROM events, (SELECT unnest(range(0, 3)) AS k))
SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, count(*) AS n FROM w GROUP BY 1""")  # fmt: skip
def sliding_windows(spark, sf_dir):
    return W.sliding(table(spark, sf_dir, "events"), "3 hours", "1 hour", F.count("*").alias("n"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def session_windows(spark, sf_dir):
    return W.sessions(table(spark, sf_dir, "events"), "2 hours", F.count("*").alias("n"), keys=("user_id",))
