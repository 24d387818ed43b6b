"""Length-balanced partitions: k-way differencing, groups kept whole, token budgets; of any number of rows.

A partial solution is k sets with their sums. Two are merged by joining the largest set of one with the smallest of
the other, the two of the widest spread first (differencing). Rows are numbered in order of length over range partitions
and dealt, k rows of near equal length at a time, to runs of about CHUNK rows; a task solves a run, from single rows or,
for equal counts, from such k rows each. The runs' solutions, k sums each, are merged FAN at a time in a tree, and rows
learn their part by joins with what became of their run's sets. One run is solved exactly as the plain algorithm does;
more runs take the same steps, and merging never widens the largest spread. Over WIDE parts, rows are dealt in order of
length to trees of WIDE parts at most each.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import order
from tallyweave.scratch import materialize

#: Rows that one task solves, partial solutions that one task merges, parts that one tree of merges fills.
CHUNK, FAN, WIDE = 16_384, 64, 2048
#: Fixed values of the workload model: work is LINEAR * n + n * n.
LINEAR = 24576


def workload(length: Column) -> Column:
    """Work of a sequence of n tokens: 24576 n + n squared."""
    n = length.cast("long")
    return n * LINEAR + n * n


class _Parts:
    """k sets of items with their sums, largest sum first; empty sets aren't held."""

    __slots__ = ("parts", "sets")

    def __init__(self, sets: list[tuple[int, list[int]]], parts: int):
        self.sets = sorted((s for s in sets if s[1]), key=lambda s: (-s[0], -len(s[1]), s[1]))
        self.parts = parts

    @property
    def spread(self) -> int:
        if not self.sets:
            return 0
        return self.sets[0][0] - (self.sets[-1][0] if len(self.sets) == self.parts else 0)

    def __lt__(self, other: _Parts) -> bool:
        if self.spread != other.spread:
            return self.spread > other.spread
        for (s, x), (t, y) in itertools.zip_longest(self.sets, other.sets, fillvalue=(0, [])):
            if (-s, x) != (-t, y):
                return (-s, x) < (-t, y)
        return False

    def joined(self, other: _Parts) -> _Parts:
        """Largest of one with smallest of the other."""
        a, b, k = self.sets, other.sets, self.parts
        both = range(max(0, k - len(b)), len(a))
        return _Parts([*a[: both.start], *b[: k - len(a)], *((a[i][0] + b[k - 1 - i][0], a[i][1] + b[k - 1 - i][1]) for i in both)], k)


def _merged(solutions: list[_Parts]) -> list[tuple[int, list[int]]]:
    """The sets of all solutions merged, the two of the widest spread first."""
    heapq.heapify(solutions)
    while len(solutions) > 1:
        a, b = heapq.heappop(solutions), heapq.heappop(solutions)
        heapq.heappush(solutions, a.joined(b))
    return solutions[0].sets if solutions else []


def differencing(lengths: Sequence[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Largest-differencing partition of item numbers into `parts`; equal_size wants a multiple and gives equal counts."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        if len(order) % parts:
            raise ValueError(f"{len(order)} items don't divide into {parts} parts")
        start = [_Parts([(lengths[i], [i]) for i in order[at : at + parts]], parts) for at in range(0, len(order), parts)]
    else:
        start = [_Parts([(lengths[i], [i])], parts) for i in order]
    made = [sorted(x) for _, x in _merged(start)]
    return made + [[] for _ in range(parts - len(made))]


def greedy(lengths: Sequence[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Each item in turn to the lightest part; equal_size adds a bias that keeps counts equal."""
    bias = sum(lengths) + 1 if equal_size else 0
    loads = [(0, p) for p in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(loads)
        out[p].append(i)
        heapq.heappush(loads, (load + n + bias, p))
    return out


def balanced(lengths: Sequence[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """differencing, with every item in exactly one part and no part empty."""
    if len(lengths) < parts:
        raise ValueError(f"{len(lengths)} items for {parts} parts")
    out = differencing(lengths, parts, equal_size)
    if any(not p for p in out) or sorted(i for p in out for i in p) != list(range(len(lengths))):
        raise AssertionError("the partition is not a partition")
    return out


def balanced_groups(lengths: Sequence[int], uids: Sequence, parts: int) -> list[list[int]]:
    """Runs of equal uids stay whole; parts have equal numbers of runs and near equal work."""
    runs: list[list[int]] = []
    for i, u in enumerate(uids):
        if runs and uids[runs[-1][-1]] == u:
            runs[-1].append(i)
        else:
            runs.append([i])
    work = [sum(LINEAR * lengths[i] + lengths[i] ** 2 for i in r) for r in runs]
    return [sorted(i for g in p for i in runs[g]) for p in balanced(work, parts, equal_size=True)]


def micro_batches(lengths: Sequence[int], max_tokens: int, *, divided_by: int = 1, at_least: int = 1) -> list[list[int]]:
    """Balanced micro-batches of about max_tokens, their number rounded up to a multiple; heavy ones stand in the middle."""
    if not lengths:
        return []
    if max(lengths) > max_tokens:
        raise ValueError(f"a sequence of {max(lengths)} tokens is over the budget of {max_tokens}")
    count = max(at_least, min(len(lengths), -(-sum(lengths) // max_tokens)))
    count = min(len(lengths), -(-count // divided_by) * divided_by)
    work = [LINEAR * n + n * n for n in lengths]
    parts = sorted(balanced(work, count), key=lambda p: -sum(work[i] for i in p))
    return parts[::2][::-1] + parts[1::2]


def restore(parts: Sequence[Sequence[int]]) -> list[int]:
    """For each item number, its place in the concatenated parts."""
    flat = [i for p in parts for i in p]
    out = [0] * len(flat)
    for place, i in enumerate(flat):
        out[i] = place
    return out


def _widths(parts: int, equal_size: bool) -> list[int]:
    """The parts of each tree: WIDE at most; with equal counts all trees have as many, which a prime number of parts can't."""
    trees = -(-parts // WIDE)
    if equal_size:
        trees = next((t for t in range(trees, min(parts, 64 * trees) + 1) if parts % t == 0), 1)
    return [parts // trees + (t < parts % trees) for t in range(trees)]


def _solved(rows: DataFrame, parts: int, *, equal_size: bool = False, how: str = "differencing") -> DataFrame:
    """(row_id, part) of rows (row_id, _w), parts of a tree by falling weight."""
    n, widths = rows.count(), _widths(parts, equal_size)
    if how == "differencing" and n < parts:
        raise ValueError(f"{n} items for {parts} parts")
    if how == "differencing" and equal_size and n % parts:
        raise ValueError(f"{n} items don't divide into {parts} parts")
    trees, widest = len(widths), max(widths)
    run = -(-max(CHUNK, widest) // widest) * widest if equal_size else max(CHUNK, widest)
    ranked = order.numbered(rows, ["_w", "row_id"] if how == "differencing" else ["row_id"], "_at")
    base, extra = parts // trees, parts % trees
    seat = F.pmod("_at", F.lit(parts))  # every tree gets rows in proportion to its parts
    tree = F.when(seat < extra * (base + 1), F.floor(seat / (base + 1))).otherwise(extra + F.floor((seat - extra * (base + 1)) / base))
    starts = F.lit([0, *itertools.accumulate(widths)][:-1])
    dealt = ranked.withColumn("tree", tree.cast("int")).withColumn("_at", F.floor(F.col("_at") / parts) * F.get(F.lit(widths), F.col("tree")) + seat - F.get(starts, F.col("tree")))
    runs = -(-(-(-n // parts) * widest) // run)
    dealt = dealt.select("row_id", "_w", "tree", F.pmod(F.floor(F.col("_at") / F.get(F.lit(widths), F.col("tree"))), F.lit(runs)).alias("node"))

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row_id").reset_index(drop=True)
        made = (greedy if how == "greedy" else differencing)(own["_w"].tolist(), widths[key[0]], equal_size)
        place = {i: s for s, members in enumerate(made) for i in members}
        return own.assign(set=[place[i] for i in range(len(own))])

    solved = materialize(dealt.groupBy("tree", "node").applyInPandas(solve, "row_id long, _w long, tree int, node long, set int"), "solved")
    became = _tree(solved.groupBy("tree", "node", "set").agg(F.sum("_w").alias("total")), runs, widths)
    if became is not None:
        solved = solved.join(became, ["tree", "node", "set"]).withColumn("set", F.col("_set"))
    return solved.select("row_id", (F.get(starts, F.col("tree")) + F.col("set")).cast("int").alias("part"))


def _tree(solutions: DataFrame, nodes: int, widths: list[int]) -> DataFrame | None:
    """(tree, node, set, _set): the set of the whole solution that each run's set ends up in; None for single runs."""

    def merge(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["node", "set"]).reset_index(drop=True)
        totals = own["total"].tolist()
        parts = [_Parts([(totals[i], [i]) for i in members], widths[key[0]]) for members in own.groupby("node").groups.values()]
        into = {i: s for s, (_, members) in enumerate(_merged(parts)) for i in members}
        return own.assign(parent=own["node"] // FAN, _set=[into[i] for i in range(len(own))])

    became = None
    while nodes > 1:
        step = materialize(solutions.groupBy("tree", F.floor(F.col("node") / FAN)).applyInPandas(merge, "tree int, node long, set int, total long, parent long, _set int"), "merged")
        if became is None:
            became = step.select("tree", "node", "set", "parent", "_set")
        else:
            up = step.select("tree", F.col("node").alias("parent"), F.col("set").alias("_set"), F.col("parent").alias("_parent"), F.col("_set").alias("_up"))
            became = materialize(became.join(up, ["tree", "parent", "_set"]).select("tree", "node", "set", F.col("_parent").alias("parent"), F.col("_up").alias("_set")), "became")
        solutions = step.groupBy("tree", F.col("parent").alias("node"), F.col("_set").alias("set")).agg(F.sum("total").alias("total"))
        nodes = -(-nodes // FAN)
    return None if became is None else became.select("tree", "node", "set", "_set")


def _placed(assigned: DataFrame, part: str) -> DataFrame:
    """(row_id, part, place): places within a part in order of row_id."""
    ranked = order.numbered(assigned, [part, "row_id"], "_at")
    firsts = ranked.groupBy(part).agg(F.min("_at").alias("_first"))
    return ranked.join(firsts, part).select("row_id", part, (F.col("_at") - F.col("_first")).cast("int").alias("place"))


def _runs(df: DataFrame, uid: str) -> DataFrame:
    """df with `_run`: the number of the run of equal uids, in order of row_id, that a row is in."""
    rows = order.numbered(df, ["row_id"], "_i")
    before = rows.select((F.col("_i") + 1).alias("_i"), F.col(uid).alias("_uid"), F.lit(True).alias("_any"))
    marked = rows.join(before, "_i", "left").withColumn("_new", (F.col("_any").isNull() | ~F.col(uid).eqNullSafe(F.col("_uid"))).cast("int"))
    summed = order.prefix_sums(marked, ["row_id"], F.col("_new"), "_run")
    return summed.withColumn("_run", (F.col("_run") + F.col("_new")).cast("long"))


def assign(df: DataFrame, parts: int, *, length: str = "seqlen", uid: str | None = None, equal_size: bool = False, work: bool = False, how: str = "differencing") -> DataFrame:
    """Add `part` and `place` (the position within the part, by row_id) to rows of different row_ids.

    how: "differencing" or "greedy" (each row in turn to the lightest part of its run of CHUNK). With a uid, runs of equal
    uids stay whole, and parts have equal numbers of runs and near equal work.
    """
    cost = workload(F.col(length)) if work or uid else F.col(length).cast("long")
    if uid:
        rows = materialize(_runs(df.select("row_id", uid, cost.alias("_w")), uid).select("row_id", "_run", "_w"), "runs")
        solved = _solved(rows.groupBy(F.col("_run").alias("row_id")).agg(F.sum("_w").alias("_w")), parts, equal_size=True)
        made = rows.join(solved.withColumnRenamed("row_id", "_run"), "_run").select("row_id", "part")
    else:
        made = _solved(df.select("row_id", cost.alias("_w")), parts, equal_size=equal_size, how=how)
    return df.join(_placed(made, "part"), "row_id")


def imbalance(df: DataFrame, parts: int, *, length: str = "seqlen", part: str = "part", rows: int | None = None) -> DataFrame:
    """One row: smallest, largest and mean sum of lengths over contiguous parts and over the given ones."""
    n = rows if rows is not None else df.count()
    made = df.withColumn("_c", F.floor(F.col("row_id") / max(1, -(-n // parts))))
    before = made.groupBy("_c").agg(F.sum(length).alias("s")).agg(F.min("s").alias("before_min"), F.max("s").alias("before_max"), F.avg("s").alias("before_mean"))
    after = made.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("after_min"), F.max("s").alias("after_max"), F.avg("s").alias("after_mean"))
    return before.crossJoin(after)  # one row each


def assign_micro(df: DataFrame, max_tokens: int, *, length: str = "seqlen", divided_by: int = 1, at_least: int = 1) -> DataFrame:
    """Add `micro` and `place`: token-budget micro-batches, heavy ones in the middle; ordering by row_id restores the batch."""
    whole = df.agg(F.count("*").alias("n"), F.sum(F.col(length).cast("long")).alias("tokens"), F.max(length).alias("most")).first()
    if not whole["n"]:
        return df.withColumns({"micro": F.lit(None).cast("int"), "place": F.lit(None).cast("int")})
    if whole["most"] > max_tokens:
        raise ValueError(f"a sequence of {whole['most']} tokens is over the budget of {max_tokens}")
    count = max(at_least, min(whole["n"], -(-whole["tokens"] // max_tokens)))
    count = min(whole["n"], -(-count // divided_by) * divided_by)
    cost = df.select("row_id", workload(F.col(length)).alias("_w"))
    made = _solved(cost, count)
    ranked = order.numbered(made.join(cost, "row_id").groupBy("part").agg(F.sum("_w").alias("_w")), [F.desc("_w"), F.col("part")], "_rank")
    evens, half = (count + 1) // 2, F.floor(F.col("_rank") / 2)
    seats = ranked.select("part", F.when(F.col("_rank") % 2 == 0, evens - 1 - half).otherwise(evens + half).cast("int").alias("micro"))
    return df.join(_placed(made.join(seats, "part").select("row_id", "micro"), "micro"), "row_id")
