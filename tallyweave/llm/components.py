"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step is a grouped minimum and a join, so a hub is pre-aggregated before the shuffle and
nothing is collected. Every round is written to the shared folder, which cuts the lineage, and
the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least neighbour."""
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    else:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("x"))
    least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
    joined = both.join(least, "n")
    if large:
        out = joined.filter("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of an edge (u, v) the least node it is connected to. Edges with a null end are ignored."""
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    seen = None
    while True:
        before, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        release(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
