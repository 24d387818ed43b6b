"""Exact top-k inner-product search by columnar branch and bound (operator 5).

Components are scaled to integers, so scores are exact. A task holds its candidates in
vertical layout, one array per dimension, and accumulates a query's scores dimension block by
dimension block, the dimensions of the largest products first. After each block it drops the
candidates whose score so far plus the largest the remaining dimensions can add (the product
of what mass both vectors have left, by Cauchy-Schwarz) cannot reach the query's threshold;
survivors are compacted before the next block. The threshold is the largest of three: the k-th best
so far, the k-th largest score less what remains (a lower bound) within the tile, and the k-th best of about
SEED rows picked by a hash, which are searched before. What a task returns is k rows a query, and
a second grouping keeps the k best of all tasks.

Queries travel to the tasks in blocks of bounded bytes (QUERY_BYTES), each against all rows;
a larger query set makes more blocks, not larger ones, and a block's results are written
before the next block is read. A task works off QUERIES of them with ROWS candidates at a time.

Floating point holds scores exactly where the product of the largest norms is under 2**53. Where
it isn't, floating point with an error bound only finds what may be among the best, and whole
numbers of any length decide.

Defined results: vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without an id. Vectors of other lengths than the query's are no candidates of it.
Components and scores that no long holds count as the largest or smallest long. Ties go to the
smaller id. Rows that repeat an id are candidates each. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, trimmed

#: Bytes of the integer query vectors that are sent to the tasks at once, at most about.
QUERY_BYTES = 16 << 20
#: Dimensions of a block.
DIMS = 8
#: Candidates and queries that are searched together.
ROWS, QUERIES = 8192, 512
#: Rows that set the first thresholds, about.
SEED = 4096
_LONGEST = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * component) of every vector whose components are all finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def search_block(ids: np.ndarray, cand: np.ndarray, qids: np.ndarray, queries: np.ndarray, best: list, k: int, dims: int = DIMS, least: np.ndarray | None = None) -> int:
    """Improve `best` (a sorted list of (-score, id) per query) with candidates given as dims x rows of float64 integers; the multiplications of scores.

    least: for each query a score that k candidates are known to reach.
    """
    square = cand * cand
    whole, energy, done = square.sum(0), np.sqrt(square.mean(1)), 0
    for q, own in enumerate(queries):
        order = np.argsort(-np.abs(own) * energy, kind="stable")  # the dimensions that tell most first
        at = np.flatnonzero(ids != qids[q])
        score, mass, rest = np.zeros(len(at)), whole[at], own * own
        bar = -best[q][-1][0] if len(best[q]) == k else -np.inf
        bar = bar if least is None else max(bar, least[q])
        for a in range(0, len(own), dims):
            block = order[a : a + dims]
            if len(at) == cand.shape[1]:
                some, squares = cand[block], square[block]
            else:
                some, squares = cand[block[:, None], at], square[block[:, None], at]
            score = score + own[block] @ some
            done += some.size
            left = rest[order[a + dims :]].sum()
            if a + dims >= len(own):
                break
            mass = mass - squares.sum(0)
            room = np.sqrt(left * (np.maximum(mass, 0) + 1e-12 * whole[at])) * (1 + 1e-9) + 1e-6
            if len(at) > k:  # k candidates reach their lower bounds
                low = score - room
                bar = max(bar, np.partition(low, len(low) - k)[len(low) - k])
            stay = np.flatnonzero(score + room >= bar)
            at, score, mass = at[stay], score[stay], mass[stay]
            if not len(at):
                break
        stay = np.flatnonzero(score >= bar)
        at, score = at[stay], score[stay]
        if len(score) > 4 * k:
            top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            at, score = at[top], score[top]
        if len(at):
            best[q] = sorted([*best[q], *zip((-score).astype(np.int64).tolist(), ids[at].tolist())])[:k]
    return done


def search_wide(ids: np.ndarray, cand: np.ndarray, qids: np.ndarray, queries: np.ndarray, best: list, k: int) -> None:
    """The same for long integers of any size."""
    c, q = cand.astype(np.float64), queries.astype(np.float64)
    lengths = np.sqrt((c * c).sum(0))
    slack = (cand.shape[0] + 8) * 2.0**-52
    for n in range(len(q)):
        own = np.flatnonzero(ids != qids[n])
        score = q[n] @ c[:, own]
        error = slack * (np.sqrt(q[n] @ q[n]) * lengths[own]) + 1
        least = -float(best[n][-1][0]) if len(best[n]) == k else -np.inf
        if len(own) > k:
            least = max(least, float(np.partition(score - error, len(own) - k)[len(own) - k]))
        # beyond a long scores are equal, so the threshold stays within
        least = -np.inf if least < -(2.0**62) else min(least, 2.0**63) - abs(min(least, 2.0**63)) * 2.0**-52
        stay = own[score + error >= least]
        exact = [min(max(sum(map(int.__mul__, queries[n].tolist(), cand[:, i].tolist())), -_LONGEST - 1), _LONGEST) for i in stay.tolist()]
        best[n] = sorted([*best[n], *zip([-s for s in exact], ids[stay].tolist(), strict=True)])[:k]


def _searcher(block, k: int, dims: int, known: dict | None = None):
    """known: by vector length, for each query a score that k candidates are known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = block.value
        most = {n: float(np.sqrt((np.square(rows.astype(np.float64))).sum(1).max(initial=0))) for n, (_, rows) in groups.items()}
        best = {n: [[] for _ in qids] for n, (qids, _) in groups.items()}
        waiting: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {n: ([], []) for n in groups}

        def search(n: int) -> None:
            ids, vectors = waiting[n]
            if ids:
                some, cand = np.concatenate(ids), np.ascontiguousarray(np.concatenate(vectors).T)
                ids.clear()
                vectors.clear()
                own = cand.astype(np.float64)
                exact = most[n] * float(np.sqrt((own * own).sum(0).max(initial=0))) * (1 + 1e-9) < 2.0**53
                qids, rows = groups[n]
                for at in range(0, len(qids), QUERIES):
                    tile = slice(at, at + QUERIES)
                    found = best[n][tile]
                    if exact:
                        search_block(some, own, qids[tile], rows[tile].astype(np.float64), found, k, dims, known[n][tile] if known else None)
                    else:
                        search_wide(some, cand, qids[tile], rows[tile], found, k)
                    best[n][tile] = found

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lens = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lens) - lens
            for n in np.unique(lens).tolist():
                if n in groups:
                    rows = np.flatnonzero(lens == n)
                    for a in range(0, len(rows), ROWS):
                        some = rows[a : a + ROWS]
                        waiting[n][0].append(ids[some])
                        waiting[n][1].append(flat[starts[some][:, None] + np.arange(n)])
                        if sum(map(len, waiting[n][0])) >= ROWS:
                            search(n)
        for n, (qids, _) in groups.items():
            search(n)
            rows = [(q, i, -s) for q, own in zip(qids.tolist(), best[n], strict=True) for s, i in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["query_id", "vec_id", "score"])

    return run


def _first_scores(whole: DataFrame, asked: dict, sent, k: int, dims: int, share: int) -> dict:
    """By vector length, the k-th best score of each query among the rows whose hash is 0 over `share`: a floor for all rows' k-th best."""
    some = whole.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)  # sets thresholds only; all rows are searched after
    found = some.mapInArrow(trimmed(_searcher(sent, k, dims)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", "score")
    floor = {r["query_id"]: float(r["score"]) for r in ranked.collect()}  # a row a query
    seen, counts = np.unique(np.concatenate([ids for ids, _ in asked.values()] or [np.zeros(0, np.int64)]), return_counts=True)
    alone = set(seen[counts == 1].tolist())  # results of rows that share an id can't be told apart
    return {n: np.array([floor.get(i, -np.inf) if i in alone else -np.inf for i in ids.tolist()]) for n, (ids, _) in asked.items()}


def top_k(vectors: DataFrame, is_query, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products with other rows.

    is_query: a Column over id_col.
    """
    spark = vectors.sparkSession
    importable(spark)
    whole = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(vectors.filter(is_query), id_col, vec_col, scale)
    size = asked.agg(F.sum(8 * F.size("v") + 8).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // query_bytes))
    share = max(1, whole.count() // SEED)
    parts = []
    for b in range(blocks):
        lists: dict[int, tuple[list, list]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toLocalIterator():  # about query_bytes
            own = lists.setdefault(len(r["v"]), ([], []))
            own[0].append(r["id"])
            own[1].append(np.array(r["v"], np.int64))
        asked_now = {n: (np.array(ids, np.int64), np.stack(rows)) for n, (ids, rows) in lists.items()}
        sent = spark.sparkContext.broadcast(asked_now)
        known = _first_scores(whole, asked_now, sent, k, dims, share)
        part = whole.mapInArrow(trimmed(_searcher(sent, k, dims, known)), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = materialize(part, "top-k")
            sent.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
