"""Views of the provided tables as scored sequences, and the registry of queries.

An order is a response, its line items are tokens (in the order of line number, part,
supplier, price), its customer is the prompt group and the market segment the data source.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with the SQL that gives the same rows where SQL can."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to four tasks a core, for work that costs far more than to shuffle them: a small file is read by few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def r6(c: Column | str, name: str) -> Column:
    """Rounded to six digits, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name)


def _fields() -> dict[str, Column]:
    return {"r": F.col("l_discount"), "m": F.when(F.col("l_returnflag") == "R", 0).otherwise(1), "v": F.col("l_tax"), "olp": -F.col("l_quantity") / 50}


#: The arrays of a row: the fields of a token that each needs, and its element.
ARRAYS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "rewards": (("r",), lambda x: x["r"]),
    "mask": (("m",), lambda x: x["m"]),
    "values": (("v",), lambda x: x["v"]),
    "old_logp": (("olp",), lambda x: x["olp"]),
    "rollout_logp": (("olp", "r"), lambda x: x["olp"] + (x["r"] - 0.05) * 4),
    "logp": (("olp", "v"), lambda x: x["olp"] + (x["v"] - 0.04) * 5),
    "ref_logp": (("olp", "r", "v"), lambda x: x["olp"] + x["r"] - x["v"]),
    "sum_pi_sq": (("olp",), lambda x: F.exp(2 * x["olp"]) + 0.01),
}


def rollouts(spark: SparkSession, sf_dir: str, *arrays: str) -> DataFrame:
    """One row an order: row_id, uid, data_source, pred and the named per-token arrays (all by default).

    Only the fields that these arrays need are collected, so only their columns are read and shuffled.
    """
    names = arrays or tuple(ARRAYS)
    need = dict.fromkeys(f for n in names for f in ARRAYS[n][0])
    fields = _fields()
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[fields[f].alias(f) for f in need]).alias("t"))
    seq = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("t")).alias("t"))  # an order's few lines
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    made = seq.join(orders, seq["l_orderkey"] == orders["o_orderkey"]).join(segments, F.col("o_custkey") == F.col("c_custkey"))
    return made.select(
        F.col("l_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.col("c_mktsegment").alias("data_source"), F.col("o_orderpriority").alias("pred"), *[F.transform("t", ARRAYS[n][1]).alias(n) for n in names],
    )


#: The same view in long form, for SQL.
TOK = """tok AS (
  SELECT l_orderkey AS row_id, o_custkey AS uid, c_mktsegment AS data_source, o_orderpriority AS pred,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    l_discount AS r, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m, l_tax AS v, -l_quantity / 50 AS olp,
    -l_quantity / 50 + (l_discount - 0.05::DOUBLE) * 4 AS rlp, -l_quantity / 50 + (l_tax - 0.04::DOUBLE) * 5 AS lp, -l_quantity / 50 + l_discount - l_tax AS ref,
    exp(2 * (-l_quantity / 50)) + 0.01::DOUBLE AS spi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

#: Scores of rows, with their group's statistics.
GRP = f"""{TOK}, s AS (SELECT row_id, uid, data_source, any_value(pred) AS pred, sum(r) AS s, sum(m)::DOUBLE AS n, count(*) AS len FROM tok GROUP BY row_id, uid, data_source),
g AS (SELECT *, count(*) OVER w AS c, avg(s) OVER w AS mu, stddev_samp(s) OVER w AS sd, sum(s) OVER w AS ss FROM s WINDOW w AS (PARTITION BY uid))"""
