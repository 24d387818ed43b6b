"""Queries on tables whose rows don't divide evenly, and on rows that the provided small tables lack, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave import registry
from tallyweave.operators import dispatch
from tests.test_oracles import rows_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def hold(spark, folder, name, **tables):
    """The query's rows are its SQL's over these tables (name -> DuckDB SQL)."""
    con = duckdb.connect()
    for t, made in tables.items():
        con.execute(f"copy ({made}) to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return got


def documents(sf, rows):
    return f"select * from read_parquet('{sf}/documents.parquet') order by doc_id limit {rows}"


@pytest.mark.parametrize("rows", [7, 101, 102, 103])
def test_splits_of_rows_that_do_not_divide(spark, sf, tmp_path, rows):
    got = hold(spark, tmp_path, "dataset_equal_splits", documents=documents(sf, rows))
    assert got["rows"].sum() == rows


@pytest.mark.parametrize("rows", [19, 103])
def test_batches_of_rows_that_do_not_divide(spark, sf, tmp_path, rows):
    got = hold(spark, tmp_path, "verb_batches", documents=documents(sf, rows))
    assert set(got["batch"]) == set(range(-(-rows // 20)))


def test_shuffled_batches_of_rows_that_do_not_divide(spark, sf, tmp_path):
    duckdb.sql(f"copy ({documents(sf, 103)}) to '{tmp_path}/documents.parquet'")
    got = QUERIES["verb_batches_shuffled"](spark, str(tmp_path)).toPandas()
    for epoch in (0, 1):
        own = got[got["epoch"] == epoch]
        assert sorted(own["row_id"]) == list(range(103))
        assert own.groupby("batch").size().to_dict() == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, 5: 3}


def test_groups_without_unmasked_tokens(spark, sf, tmp_path):
    """Customer 1 has one order and customer 2 two whose tokens are all masked, customer 3 an order of either kind."""
    orders = f"select * replace (i::{{k}} as o_orderkey, c::{{c}} as o_custkey) from (values (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)) v(i, c), (select * from read_parquet('{sf}/orders.parquet') limit 1)"
    lines = f"select * replace (i::{{k}} as l_orderkey, case when i = 5 then 'N' else 'R' end as l_returnflag) from (values (1), (2), (3), (4), (5)) v(i), (select * from read_parquet('{sf}/lineitem.parquet') limit 3)"
    kinds = {f"{t}.{c}": k for t in ("orders", "lineitem", "customer") for c, k in duckdb.sql(f"select column_name, column_type from (describe select * from read_parquet('{sf}/{t}.parquet'))").fetchall()}
    customers = f"select * replace (i::{kinds['customer.c_custkey']} as c_custkey) from (values (1), (2), (3)) v(i), (select * from read_parquet('{sf}/customer.parquet') limit 1)"
    got = hold(
        spark, tmp_path, "adv_opo", orders=orders.format(k=kinds["orders.o_orderkey"], c=kinds["orders.o_custkey"]), lineitem=lines.format(k=kinds["lineitem.l_orderkey"]), customer=customers,
    )
    assert got["advantages"].isna().groupby(got["row_id"]).all().to_dict() == {1: False, 2: True, 3: True, 4: False, 5: False}


@pytest.mark.parametrize("rows", [102, 103])
def test_replicas_of_rows_that_do_not_divide(spark, sf, tmp_path, rows):
    """The row left over is in a part of its own, which the mapping gives to no worker."""
    hold(spark, tmp_path, "dispatch_replicas", documents=documents(sf, rows))
    df = spark.range(7).withColumnRenamed("id", "row_id")
    parts = {r["row_id"]: r["rank"] for r in dispatch.split(df, 2, rest=True).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}
    assert sorted(r["row_id"] for r in dispatch.replicas(dispatch.split(df, 2, rest=True), [0, 1, 2]).collect()) == list(range(7))


def test_scorers_that_fail_on_wrong_answers_too(spark, sf, tmp_path):
    """103 is odd, so its answer is wrong, and 6 over 97, where the scorer raises."""
    got = hold(spark, tmp_path, "scores_in_time", supplier=f"select * replace ((i + 95)::bigint as s_suppkey) from range(14) t(i), (select * from read_parquet('{sf}/supplier.parquet') limit 1)")
    assert dict(zip(got["s_suppkey"], got["score"], strict=True))[103] == 0.0


def test_many_samples_of_one_queue_in_one_micro_batch(spark, tmp_path):
    """400,000 samples of one queue in one file: the work grows with the samples, not with their square, and the rest waits."""
    from time import time

    from tallyweave.streaming import queues

    n = 400_000
    spark.range(n).select(F.lit(0).cast("long").alias("queue"), (n - F.col("id")).alias("sample_id"), (F.col("id") % 7).cast("double").alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = queues.read_stream(spark, f"{tmp_path}/in")
    began = time()
    got = queues.run_to_table(queues.count_windows(stream, 3), "append", "t-many").toPandas().sort_values("window")
    assert time() - began < 30
    assert got["window"].tolist() == list(range(n // 3))
    assert (got["first"] == 3 * got["window"] + 1).all() and (got["last"] == 3 * got["window"] + 3).all()
    assert (got["total"] == [sum((n - 3 * w - k) % 7 for k in (1, 2, 3)) for w in got["window"]]).all()


def test_commands_of_one_micro_batch_are_held_as_numbers():
    """A command takes about 30 bytes while it waits for its turn, whatever its op; ops keep their order."""
    import tracemalloc

    import pandas as pd

    from tallyweave.streaming import queues

    n, size = 100, 10_000
    frame = pd.DataFrame({"at": range(size), "op": ["put", None, "get", "close"] * (size // 4), "value": [1.0, None] * (size // 2), "bytes": [None, 5.0] * (size // 2)})
    tracemalloc.start()
    ats, (codes, ops), values, nulls, weights = queues._commands(frame.copy() for _ in range(n))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * n * size
    assert ops == [None, "close", "get", "put"] and [ops[c] for c in codes[:4]] == ["put", None, "get", "close"]
    assert len(ats) == n * size and nulls[:2].tolist() == [False, True] and weights[:2].tolist() == [0, 5] and values[0] == 1


def test_answers_are_compared_once_a_pair_and_by_all_tasks(spark, sf):
    from tallyweave.functions import scoring

    calls = spark.sparkContext.accumulator(0)

    def counted(given, truth):
        calls.add(1)
        return given == truth

    df = spark.range(1000, numPartitions=1).select((F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") % 2 == 0, "1").alias("b"))
    got = df.select("a", "b", scoring._pairwise(counted, "boolean")(F.col("a"), F.col("b")).alias("x")).collect()
    assert calls.value == 3 and all(r["x"] == (None if r["b"] is None else r["a"] == "1") for r in got)
    for name in ("symbolic_answers", "strict_answers"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_pacing_is_a_token_bucket_and_needs_no_python(spark):
    import random

    from tallyweave.streaming import queues

    def bucket(rows, rate, most):
        held, now, out = most, None, []
        for time, tokens in rows:
            start = time if now is None else max(now, time)
            held = held if now is None else min(most, held + (start - now) * rate)
            wait = max(0.0, (tokens - held) / rate)
            held, now = held + wait * rate - tokens, start + wait
            out.append(now)
        return out

    rng = random.Random(3)
    rows = [(q, i, rng.choice([0.0, i / 4, rng.uniform(-5, 60)]), rng.choice([0.0, 1.0, rng.uniform(0, 9)])) for q in range(5) for i in range(60)]
    for rate, most in ((2.0, 4.0), (0.7, None), (5.0, 1.0)):
        df = queues.paced(spark.createDataFrame(rows, "queue int, at int, time double, tokens double"), rate, most)
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r["queue"], r["at"]): r["granted"] for r in df.collect()}
        for q in range(5):
            assert [got[q, i] for i in range(60)] == pytest.approx(bucket([r[2:] for r in rows if r[0] == q], rate, most or rate))


def test_rollup_draws_are_those_of_plain_lists():
    """All prompts' metrics equal the reducers over lists, bit by bit, with ties of votes and values; 300 prompts take seconds."""
    import random
    from time import time

    from tallyweave.operators import evaluation as E

    rng = random.Random(5)
    for n in (1, 2, 3, 7, 16):
        values = [rng.choice([0.0, 0.25, 0.5, rng.random()]) for _ in range(n)]
        votes = [rng.choice(["a", "b", None]) for _ in range(n)]
        got = dict(E._prompt_metrics(values, votes, 100, 42))
        for k in E.subset_sizes(n) if n > 1 else []:
            pairs = list(zip(values, votes, strict=True))
            reducers = [lambda p: max(v for v, _ in p), lambda p: min(v for v, _ in p), lambda p: E.majority([(w, v) for v, w in p])]
            for name, (mean, std) in zip(("best", "worst", "maj"), E.bootstrap(pairs, k, reducers, 100, 42), strict=True):
                assert (got[f"{name}@{k}/mean"], got[f"{name}@{k}/std"]) == (mean, std)
    began = time()
    for _ in range(300):
        E._prompt_metrics([rng.random() for _ in range(16)], [rng.choice("abcde") for _ in range(16)], 1000, 42)
    assert time() - began < 1.5


def test_long_texts_are_cut_into_sentences_in_linear_time(spark):
    """40,000 sentences of one text in seconds; rules at the ends of texts, after initials, abbreviations, numbers and closing quotes."""
    from time import time

    from tallyweave.functions import textmodels as T

    known = T.Boundaries(["etc", "dr"], ["the"])
    texts = [None, "", " \n ", "One! two", ' Hi!!\n\nDr. No said "etc." and left. The end. ', "J. S. Bach wrote etc. The rest? (yes.) On the 3. may it.", "What!\nNo?! So. Then"]
    want = [
        None, [], [], ["One!", "two"], ["Hi!!", 'Dr. No said "etc." and left.', "The end."], ["J. S. Bach wrote etc.", "The rest?", "(yes.)", "On the 3. may it."], ["What!", "No?!", "So.", "Then"],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r["s"] for r in df.select("i", T.sentences(F.col("text"), known).alias("s")).orderBy("i").collect()] == want
    long = spark.range(1).select(F.repeat(F.lit("It ended. "), 40_000).alias("text"))
    began = time()
    assert long.select(F.size(T.sentences(F.col("text"), known)).alias("n")).first()["n"] == 40_000
    assert time() - began < 20
    kinds = spark.createDataFrame([('"(Dr.)",',), ("«U.S.»",), ("...",), ("Ende!?",)], "t string").select(T._kind(F.col("t")).alias("k"), T._mark(F.col("t")).alias("m")).collect()
    assert [(r["k"], r["m"]) for r in kinds] == [("dr", ","), ("u.s", "."), ("", "."), ("ende", "?")]


BLANK = "VALUES (1, 'a, the'), (2, NULL), (3, ''), (4, '  '), (5, chr(160) || chr(12288)), (6, chr(9)), (7, chr(10) || ' '), (8, chr(8232)), (9, 'The tHe thethe THE')"
REPEATED = "VALUES (1, 'a, b'), (1, 'the the the the the'), (2, 'c'), (3, 'the the, the the the'), (3, 'd, e')"


@pytest.mark.parametrize(("rows", "kept"), [(BLANK, 5), (REPEATED, 5)])
def test_constraint_scores_of_blank_texts_and_repeated_ids(spark, tmp_path, rows, kept):
    got = hold(spark, tmp_path, "checks_constraint_score", documents=f'select x::bigint as doc_id, t as "text" from ({rows}) v(x, t)')
    assert len(got) == kept
