"""Scorers with a deadline, and metrics that are written once whatever fails."""

import os
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.functions import managers as R
from tallyweave.functions.deadline import Failed, Supervised
from tallyweave.sources import metricsink as M


def odd(x):
    if x == "loop":
        while True:
            pass
    if x == "sleep":
        time.sleep(60)
    if x == "die":
        os._exit(3)
    return 1 / int(x)


def test_calls_with_a_deadline():
    began = time.time()
    with Supervised(odd, 0.4) as call:
        out = []
        for x in ["2", "loop", "4", "0", "die", "5", "sleep", "x", "1"]:
            try:
                out.append(call(x))
            except Failed as error:
                out.append(str(error).split(":")[0])
        assert out == [0.5, "no answer in time", 0.25, "ZeroDivisionError", "no answer in time", 0.2, "no answer in time", "ValueError", 1.0]
        assert call.started == 4
        child = call.child
    assert call.child is None and time.time() - began < 20
    with pytest.raises(ValueError, match="closed"):
        child.is_alive()


def test_neighbours_keep_their_scores(spark):
    df = spark.createDataFrame([(i, "s", x, "g") for i, x in enumerate(["1", "loop", "2", "die", "0", "4", None])], "i int, s string, r string, g string").coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", R.each(lambda s, r, g: odd(r), "s", "r", "g", seconds=0.5).alias("x")).collect()}
    assert got == {0: 1.0, 1: None, 2: 0.5, 3: None, 4: None, 5: 0.25, 6: None}
    made = R.scored(df.filter("i < 3").withColumn("mask", F.array(F.lit(1), F.lit(1))), "prime", R.each(lambda s, r, g: odd(r), "s", "r", "g", seconds=0.5))
    assert [r["token_scores"] for r in made.orderBy("i").collect()] == [[0.0, 1.0], [0.0, 0.0], [0.0, 0.5]]


@pytest.fixture(scope="module")
def sink(spark):
    M.register(spark)
    return spark


def metrics(spark, n, step, parts=3):
    return spark.range(n).repartition(parts).select(F.lit(step).cast("long").alias("step"), F.concat(F.lit("m/é"), "id").alias("name"), (F.col("id") / 2).alias("value"))


def read(spark, path):
    return sorted((r["step"], r["name"], r["value"]) for r in spark.read.format("metric-lines").load(str(path)).collect())


def test_appended_and_replaced(sink, tmp_path):
    assert read(sink, tmp_path / "none") == []
    path = tmp_path / "log"
    for step in (1, 2):
        metrics(sink, 10, step).write.format("metric-lines").mode("append").save(str(path))
    want = sorted((s, f"m/é{i}", i / 2) for s in (1, 2) for i in range(10))
    assert read(sink, path) == want and read(sink, f"file://{path}") == want
    metrics(sink, 0, 3).write.format("metric-lines").mode("append").save(str(path))
    assert read(sink, path) == want
    metrics(sink, 4, 9).write.format("metric-lines").mode("overwrite").save(str(path))
    assert read(sink, path) == sorted((9, f"m/é{i}", i / 2) for i in range(4))
    assert not list((path / M.STAGED).iterdir())


def test_a_failing_task_leaves_no_line(sink, tmp_path):
    path = tmp_path / "log"
    metrics(sink, 5, 1).write.format("metric-lines").mode("append").save(str(path))
    bad = metrics(sink, 50, 2).withColumn("value", F.when(F.col("name") == "m/é49", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        bad.write.format("metric-lines").mode("append").save(str(path))
    assert [s for s, _, _ in read(sink, path)] == [1] * 5
    with pytest.raises(PySparkException):
        sink.range(3).write.format("metric-lines").mode("append").save(str(path))


def test_an_attempt_twice_counts_once(tmp_path):
    writer = M.MetricWriter(str(tmp_path), ["step", "name", "value"], False)
    rows = [{"step": 1, "name": "a", "value": 0.5}, {"step": 1, "name": "b", "value": None}]
    first, again, empty = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    assert first.file != again.file and empty.file is None and M.committed(str(tmp_path)) == []
    writer.commit([again, empty, None])
    (file,) = M.committed(str(tmp_path))
    assert len(Path(file).read_text().splitlines()) == 2 and not (tmp_path / M.STAGED / writer.job).exists()
    other = M.MetricWriter(str(tmp_path), ["step", "name", "value"], False)
    other.write(iter(rows))
    other.abort([None])
    assert M.committed(str(tmp_path)) == [file] and not (tmp_path / M.STAGED / other.job).exists()
