"""Streams of versioned samples: a bounded queue that drops its oldest, count windows, staleness.

The stateful operators run as applyInPandasWithState, keyed by queue; state is bounded by the
queue's capacity. The same functions replay a finished table in batch for tests and oracles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.operators import order
from tallyweave.scratch import fresh_path

QUEUE_OUT = "queue long, produced long, dropped long, size long, oldest long, newest long"
QUEUE_STATE = "produced long, dropped long, ids array<bigint>"


def bounded_queue(samples: DataFrame, capacity: int, *, key: str = "queue", order: str = "sample_id") -> DataFrame:
    """(queue, produced, dropped, size, oldest, newest) after each micro-batch of put samples.

    A full queue drops its oldest sample for each that comes in.
    """

    def put(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        produced, dropped, ids = state.get if state.exists else (0, 0, [])
        new = sorted(int(x) for f in frames for x in f[order])
        ids = [*ids, *new]
        over = max(0, len(ids) - capacity)
        ids = ids[over:]
        produced, dropped = produced + len(new), dropped + over
        state.update((produced, dropped, ids))
        yield pd.DataFrame({"queue": [k[0]], "produced": [produced], "dropped": [dropped], "size": [len(ids)], "oldest": [ids[0] if ids else None], "newest": [ids[-1] if ids else None]})

    return samples.groupBy(key).applyInPandasWithState(put, QUEUE_OUT, QUEUE_STATE, "update", GroupStateTimeout.NoTimeout)


#: Rows of an output frame of the operators that give more than a row a key and micro-batch.
_OUT_ROWS = 1 << 14


class _Column:
    """Numbers of one kind that come in frame by frame, held once in a buffer that grows in place."""

    def __init__(self, kind: str) -> None:
        self.kind, self.held = np.dtype(kind), bytearray()

    def add(self, more: pd.Series | np.ndarray | list) -> None:
        self.held += memoryview(np.ascontiguousarray(more, dtype=self.kind)).cast("B")

    def array(self) -> np.ndarray:
        return np.frombuffer(self.held, dtype=self.kind)


WINDOW_OUT = "queue long, window long, first long, last long, total double, samples long"
WINDOW_STATE = "made long, ids array<bigint>, values array<double>"


def count_windows(samples: DataFrame, size: int, *, key: str = "queue", order: str = "sample_id", value: str = "value") -> DataFrame:
    """(queue, window, first, last, total, samples): a row whenever exactly `size` samples have come in; the rest waits."""

    def take(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, ids, values = state.get if state.exists else (0, [], [])
        wait = len(ids)  # what waits is earlier than what comes in
        new_ids, new_values = _Column("int64"), _Column("float64")
        new_ids.add(ids)
        new_values.add(values)
        for f in frames:
            new_ids.add(f[order].astype("int64"))
            new_values.add(f[value])
        i, v = new_ids.array(), new_values.array()
        by = np.concatenate([np.arange(wait), wait + np.lexsort((v[wait:], i[wait:]))])
        full = len(by) // size
        rest = by[full * size :]
        state.update((made + full, i[rest].tolist(), v[rest].tolist()))
        step = max(1, _OUT_ROWS // size)
        for at in range(0, full, step):
            end = min(full, at + step)
            part = by[at * size : end * size].reshape(-1, size)
            own, weights = i[part], v[part]
            yield pd.DataFrame({"queue": k[0], "window": np.arange(made + at, made + end), "first": own[:, 0], "last": own[:, -1], "total": [float(sum(w)) for w in weights.tolist()], "samples": size})

    return samples.groupBy(key).applyInPandasWithState(take, WINDOW_OUT, WINDOW_STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what its source has now, each micro-batch written with its number as `batch`."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def read_stream(spark: SparkSession, path: str, files_a_trigger: int = 8) -> DataFrame:
    """A stream over a parquet table: the files of a folder, or one file of its parent folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def latest(df: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last micro-batch that had one."""
    w = Window.partitionBy(key).orderBy(F.desc("batch"))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "batch")


def capacity_of(required: int, staleness: float, sync_steps: int, servers: int) -> tuple[int, int]:
    """(samples that may be queued or in flight, samples generated at once)."""
    most = int(required * (staleness + 1) * sync_steps)
    return most, min(16 * servers, most)


def should_pause(queued: int, capacity: int, stale: int, most_stale: int) -> bool:
    """Back-pressure: the queue is full, or as many samples are stale as may be."""
    return queued >= capacity or stale >= most_stale


def staleness(df: DataFrame, version: str, current: int, allowed: int = 0) -> DataFrame:
    """One row: samples, those generated more than `allowed` versions ago, and their share."""
    old = (F.lit(current) - F.col(version) > allowed).cast("long")
    return df.agg(F.count("*").alias("samples"), F.coalesce(F.sum(old), F.lit(0)).alias("stale")).select("samples", "stale", (F.col("stale") / F.col("samples")).alias("stale_ratio"))


def ring(df: DataFrame, capacity: int, order: str = "row_id") -> DataFrame:
    """The rows that a ring buffer of `capacity` holds after all were added, with their slot."""
    w = Window.partitionBy("slot").orderBy(F.desc(order))
    slots = df.withColumn("slot", F.pmod(F.col(order), F.lit(capacity)))
    return slots.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def draw(df: DataFrame, count: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """`count` rows without replacement by a seeded hash; fewer rows than that are an error."""
    n = df.count()
    if n < count:
        raise ValueError(f"{n} rows, {count} wanted")
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(count)


COMMANDS = ("put", "get", "version", "clear", "stats", "close")
COMMAND_OUT = "queue long, at long, op string, sample_id long, accepted boolean, size long, produced long, consumed long, dropped long, version long, bytes long, open boolean"
COMMAND_STATE = "ids array<bigint>, sizes array<bigint>, counts array<bigint>, version long, open boolean"


def _commands(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, tuple[np.ndarray, list], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of all frames, about 30 bytes a command: at, (codes of ops in their order, ops), value, whether it is null, bytes."""
    ats, codes, values, nulls, weights = (_Column(kind) for kind in ("int64", "int32", "int64", "bool", "int64"))
    known: dict[str | None, int] = {}
    for f in frames:
        ats.add(f["at"].astype("int64"))
        own, names = pd.factorize(f["op"], use_na_sentinel=False)
        codes.add(np.array([known.setdefault(None if pd.isna(n) else n, len(known)) for n in names], dtype="int32")[own])
        nulls.add(f["value"].isna())
        values.add(f["value"].fillna(0).astype("int64"))
        weights.add(f["bytes"].fillna(0).astype("int64"))
    ops = sorted(known, key=lambda n: (n is not None, n or ""))
    place = np.array([ops.index(n) for n in known], dtype="int32")
    return ats.array(), (place[codes.array()], ops), values.array(), nulls.array(), weights.array()


def command_queue(commands: DataFrame, capacity: int, *, key: str = "queue") -> DataFrame:
    """What a bounded queue answers to each command, in order of `at`, with its statistics after it.

    commands: (queue, at, op, value, bytes). "put" adds sample `value` of so many bytes; a full queue drops
    its oldest and says accepted = false. "get" takes the oldest, null where there is none. "version" sets
    the version, "clear" drops all that wait (these count neither as dropped nor as consumed), "stats"
    only reports, "close" ends: later puts are not accepted and change nothing, gets go on until the
    queue is empty. Unknown ops report accepted = null. A micro-batch's commands are taken in order;
    micro-batches must come in order. State is bounded by the capacity.
    """

    def answer(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, sizes, counts, version, open_ = state.get if state.exists else ([], [], [0, 0, 0], 0, True)
        ids, sizes, (produced, consumed, dropped) = deque(ids), deque(sizes), counts
        waiting = sum(sizes)
        ats, ops, values, nulls, weights = _commands(frames)
        names = [x.split(" ")[0] for x in COMMAND_OUT.split(", ")]
        by = np.lexsort((weights, values, nulls, ops[0], ats))
        for start in range(0, len(by), _OUT_ROWS):
            part = by[start : start + _OUT_ROWS]
            out = []
            for at, code, value, null, size in zip(ats[part].tolist(), ops[0][part].tolist(), values[part].tolist(), nulls[part].tolist(), weights[part].tolist(), strict=True):
                op, value = ops[1][code], None if null else value
                accepted, sample = op in COMMANDS or None, None
                if op == "put":
                    sample, accepted = value, open_
                    if open_:
                        produced += 1
                        ids.append(value)
                        sizes.append(size)
                        waiting += size
                        if len(ids) > capacity:
                            ids.popleft()
                            waiting -= sizes.popleft()
                            dropped, accepted = dropped + 1, False
                elif op == "get":
                    accepted = bool(ids)
                    if ids:
                        sample, consumed = ids.popleft(), consumed + 1
                        waiting -= sizes.popleft()
                elif op == "version":
                    version = value or 0
                elif op == "clear":
                    ids.clear()
                    sizes.clear()
                    waiting = 0
                elif op == "close":
                    open_ = False
                out.append((k[0], at, op, sample, accepted, len(ids), produced, consumed, dropped, version, waiting, open_))
            yield pd.DataFrame({n: pd.Series(v, dtype="Int64" if n == "sample_id" else "boolean" if n == "accepted" else None) for n, v in zip(names, zip(*out, strict=True), strict=True)})
        state.update((list(ids), list(sizes), [produced, consumed, dropped], version, open_))

    return commands.groupBy(key).applyInPandasWithState(answer, COMMAND_OUT, COMMAND_STATE, "append", GroupStateTimeout.NoTimeout)


def paced(requests: DataFrame, rate: float, most: float | None = None, *, key: str = "queue") -> DataFrame:
    """(key, at, time, tokens, granted): when a token bucket grants each request, asked one after the other.

    requests: (key, at, time, tokens). The bucket starts full, holds `most` tokens (`rate` by default) and gains
    `rate` a second. A request waits until its tokens are there; one over `most` is granted once what it
    lacks has had time to come, and leaves the bucket owing it.
    """
    most = most or rate
    asked = Window.partitionBy(key).orderBy(F.col("at").asc_nulls_last())
    upto, before = asked.rowsBetween(Window.unboundedPreceding, 0), asked.rowsBetween(Window.unboundedPreceding, -1)
    # The bucket would be full again at `full`: the seconds of all tokens so far, on top of the longest time that it was full and idle.
    owed = F.coalesce(F.sum("tokens").over(before), F.lit(0.0)) / rate
    made = requests.select(key, "at", "time", "tokens").withColumn("_idle", F.col("time") - owed).withColumn("_owed", F.sum("tokens").over(upto) / rate)
    made = made.withColumn("_full", F.max("_idle").over(upto) + F.col("_owed"))
    made = made.withColumn("granted", F.max(F.greatest(F.col("time"), F.col("_full") - most / rate)).over(upto))
    return made.select(key, "at", "time", "tokens", F.col("granted").cast("double").alias("granted"))


def servers(requests: DataFrame, count: int, *, request: str = "request_id", at: str = "at") -> DataFrame:
    """Add `server`: requests with an id seen before go where it went first, new ids in turn to the next server."""
    first = requests.groupBy(request).agg(F.min(at).alias("_first"))
    turn = order.numbered(first, ["_first", request], "_turn").select(F.col(request).alias("_id"), F.pmod("_turn", F.lit(count)).cast("int").alias("server"))
    return requests.join(turn, F.col(request).eqNullSafe(F.col("_id"))).drop("_id")
