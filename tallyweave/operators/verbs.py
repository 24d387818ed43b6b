"""Positional verbs over rows that carry an explicit `row_id` (0, 1, 2, ... in order).

Verbs that need the number of rows take it as an argument or count it once. None collects
rows; results carry their new order in `row_id`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import order
from tallyweave.operators.order import numbered

ID = "row_id"


def with_row_ids(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Number rows from 0 in the given order, without gathering them in one task."""
    return numbered(df, by, ID)


def select(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The named columns, which must exist, and those optional ones that do."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*dict.fromkeys([ID, *columns, *[c for c in optional if c in df.columns]]))


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); both keep row_id."""
    return select(df, columns), df.drop(*[c for c in columns if c != ID])


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names but {len(new)} new ones")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def gather(df: DataFrame, indices: Sequence[int] | DataFrame) -> DataFrame:
    """Rows by number, in that order, repeats allowed. indices: a list, or a DataFrame (out_pos, row_id)."""
    if not isinstance(indices, DataFrame):
        spark = df.sparkSession
        indices = spark.createDataFrame([(i, int(x)) for i, x in enumerate(indices)], f"out_pos long, {ID} long")
    return indices.join(df, ID).withColumn(ID, F.col("out_pos")).drop("out_pos").select(*df.columns)


def where(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask holds, numbered anew."""
    return renumber(df.filter(mask))


def renumber(df: DataFrame) -> DataFrame:
    """Close the gaps in row_id."""
    return numbered(df, [ID], ID).select(*df.columns)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, rows: int | None = None) -> DataFrame:
    """Rows start:stop:step with Python's meaning, negatives included."""
    n = rows if rows is not None else df.count()
    picked = range(n)[start:stop:step]
    if not len(picked):
        return df.limit(0)
    first, by = picked.start, picked.step
    low, high = min(picked[0], picked[-1]), max(picked[0], picked[-1])
    at = F.col(ID) - first
    kept = df.filter(F.col(ID).between(low, high)).filter(F.pmod(at, F.lit(abs(by))) == 0)
    return kept.withColumn(ID, (at / by).cast("long"))


def repeat(df: DataFrame, times: int, interleave: bool = True, rows: int | None = None) -> DataFrame:
    """Every row `times` times: side by side (aabb), or the whole batch over again (abab)."""
    made = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_k", F.lit(0))
    new = F.col(ID) * times + F.col("_k") if interleave else F.col("_k") * (rows if rows is not None else df.count()) + F.col(ID)
    return made.withColumn(ID, new.cast("long")).drop("_k")


def repeat_each(df: DataFrame, times: str | Column) -> DataFrame:
    """Every row as often as its own count says, numbered anew; a count of 0 drops it."""
    count = F.col(times) if isinstance(times, str) else times
    made = df.withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.greatest(count.cast("int"), F.lit(0)))))
    return numbered(made, [ID], ID).select(*df.columns)


def unfold(df: DataFrame, parts: int, columns: Sequence[str]) -> DataFrame:
    """Split the named arrays into `parts` equal pieces, a row each; other columns repeat."""
    size = F.size(F.col(columns[0]))
    even = F.when(size % parts == 0, size / parts).otherwise(F.raise_error(F.lit(f"length not divisible by {parts}")).cast("double")).cast("int")
    made = df.withColumn("_n", even).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        made = made.withColumn(c, F.slice(c, F.col("_k") * F.col("_n") + 1, F.col("_n")))
    return made.withColumn(ID, (F.col(ID) * parts + F.col("_k")).cast("long")).select(*df.columns)


def fold(df: DataFrame, size: int) -> DataFrame:
    """Every `size` rows to one, with an array for each column in row order."""
    others = [c for c in df.columns if c != ID]
    got = df.groupBy(F.floor(F.col(ID) / size).alias("_g")).agg(F.sort_array(F.collect_list(F.struct(ID, *others))).alias("t"))
    return got.select(F.col("_g").cast("long").alias(ID), *[F.col(f"t.{c}").alias(c) for c in others])


def unfold_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The inverse of fold for arrays of one length: a row for each place; columns not named repeat."""
    others = [c for c in df.columns if c not in columns and c != ID]
    width = df.agg(F.max(F.size(columns[0])).alias("n")).first()["n"] or 0
    made = df.select(F.col(ID).alias("_g"), *others, F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in columns])).alias("_k", "_t"))
    return made.select((F.col("_g") * width + F.col("_k")).cast("long").alias(ID), *others, *[F.col("_t")[c].alias(c) for c in columns]).select(*df.columns)


def padding(df: DataFrame, count: int, which: str = "last", rows: int | None = None) -> DataFrame:
    """Append `count` copies of the first or the last row."""
    n = rows if rows is not None else df.count()
    if n == 0 or count <= 0:
        return df
    source = df.filter(F.col(ID) == (0 if which == "first" else n - 1))
    more = source.withColumn("_k", F.explode(F.sequence(F.lit(n), F.lit(n + count - 1))))
    return df.unionByName(more.withColumn(ID, F.col("_k").cast("long")).select(*df.columns))


def pad_to_divisor(df: DataFrame, divisor: int, rows: int | None = None) -> tuple[DataFrame, int]:
    """Append rows from the start, over and over, up to a multiple of divisor; also says how many."""
    n = rows if rows is not None else df.count()
    extra = -n % divisor if n else 0
    if not extra:
        return df, 0
    again = df.filter(F.col(ID) < extra).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((extra - 1) // n))))
    again = again.withColumn("_new", F.col("_k") * n + F.col(ID)).filter(F.col("_new") < extra)
    return df.unionByName(again.withColumn(ID, (F.col("_new") + n).cast("long")).select(*df.columns)), extra


def unpad(df: DataFrame, count: int, rows: int | None = None) -> DataFrame:
    """Without the last `count` rows."""
    return df.filter(F.col(ID) < (rows if rows is not None else df.count()) - count) if count else df


def chunk(df: DataFrame, parts: int, rows: int | None = None, pad: bool = False, rest: bool = False) -> DataFrame:
    """Add `part`: contiguous equal parts. The rows must divide evenly unless pad, when the last part is short, or rest.

    With rest the parts have rows // parts rows, and what is left goes on as further parts of at most that size; of fewer
    rows than parts no part can be told (null).
    """
    n = rows if rows is not None else df.count()
    if rest:
        return df.withColumn("part", F.floor(F.col(ID) / F.lit(n // parts or None).cast("long")).cast("int"))
    if n % parts and not pad:
        raise ValueError(f"{n} rows don't divide into {parts} parts")
    return df.withColumn("part", F.floor(F.col(ID) / max(1, -(-n // parts))).cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    """Add `part`: runs of `size` rows, the last one short."""
    return df.withColumn("part", F.floor(F.col(ID) / size).cast("int"))


def batches(df: DataFrame, size: int, epochs: int, seed: int | None = None, rows: int | None = None, short: bool = False) -> DataFrame:
    """Add `epoch` and `batch`: mini-batches of each epoch; with a seed each epoch has its own order of hashes.

    The rows must divide evenly unless short, when an epoch's last batch holds what is left.
    """
    if not short:
        n = rows if rows is not None else df.count()
        if n % size:
            raise ValueError(f"{n} rows don't divide into batches of {size}")
    made = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return made.withColumn("batch", F.floor(F.col(ID) / size).cast("int"))
    cell = F.pmod(F.xxhash64(F.lit(seed), "epoch", ID), F.lit(1024))
    made = made.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", ID)).withColumn("_c", cell)
    counts = made.groupBy("epoch", "_c").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("epoch").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 1024 rows an epoch
    made = made.withColumn("_i", F.row_number().over(Window.partitionBy("epoch", "_c").orderBy("_h", ID)) - 1).join(before, ["epoch", "_c"])
    return made.withColumn("batch", F.floor((F.col("_before") + F.col("_i")) / size).cast("int")).select(*df.columns, "epoch", "batch")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both, row by row. Columns on both sides must be equal (null equals null, NaN equals NaN), and so must the row numbers."""
    common = [c for c in right.columns if c in left.columns and c != ID]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in common} | {ID: "_r_id"})
    both = left.join(renamed, left[ID] == renamed["_r_id"], "full_outer")
    bad = F.col(ID).isNull() | F.col("_r_id").isNull()
    for c in common:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = F.when(bad, F.raise_error(F.lit("the two sides differ in a common column or in their rows")).cast("long")).otherwise(F.col(ID))
    return both.withColumn(ID, checked).select(*left.columns, *[c for c in right.columns if c not in left.columns])


def concat(parts: Sequence[DataFrame], rows: Sequence[int] | None = None) -> DataFrame:
    """All rows of all parts in order; the columns must be the same."""
    counts = list(rows) if rows is not None else [p.count() for p in parts]
    out, at = None, 0
    for p, n in zip(parts, counts, strict=True):
        moved = p.withColumn(ID, (F.col(ID) + at).cast("long"))
        out = moved if out is None else out.unionByName(moved)
        at += n
    return out


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same rows, as often each."""
    return left.exceptAll(right.select(*left.columns)).isEmpty() and right.select(*left.columns).exceptAll(left).isEmpty()


def transitions(df: DataFrame, columns: Sequence[str], group: str, order: str) -> DataFrame:
    """Columns as current_*, and their next row's in the group as next_*; the last row's next is itself."""
    w = Window.partitionBy(group).orderBy(order)
    nexts = [F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"next_{c}") for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *[F.col(c).alias(f"current_{c}") for c in columns], *nexts)


def run_positions(df: DataFrame, key: str, out: str = "run_pos") -> DataFrame:
    """Add the position of each row within its run of equal keys in row order.

    Neighbours are compared within range partitions. Whose run a partition's first rows go on with is
    told by a row a partition: its first and last key and where its last run starts.
    """
    rows, part, _ = order.placed(df, [ID], "runs")
    own = Window.partitionBy(part).orderBy(ID)
    last, start, new, head, low, carried = (order.fresh(df, f"_{x}") for x in ("last", "start", "new", "head", "low", "carried"))
    k = F.struct(F.col(key).alias("k"))
    made = rows.withColumn(last, F.lag(k).over(own))
    made = made.withColumn(new, F.when(F.col(last).isNotNull(), ~F.col(last)["k"].eqNullSafe(F.col(key))))  # null: the partition's first row
    made = made.withColumn(start, F.max(F.when(F.col(new), F.col(ID))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(part).agg(F.min_by(k, ID).alias(head), F.max_by(k, ID).alias(last), F.min(ID).alias(low))
    opened = made.groupBy(part).agg(F.max(F.when(F.col(new), F.col(ID))).alias(start))
    joined = ends.join(opened, part).withColumn(new, F.coalesce(F.lag(last).over(Window.orderBy(part)).eqNullSafe(F.col(head)), F.lit(False)))  # a row a partition
    at, heads = None, []
    for r in sorted(joined.select(part, new, low, start).collect(), key=lambda r: r[part]):
        at = at if r[new] else r[low]
        heads.append((r[part], at))
        at = r[start] if r[start] is not None else at
    small = F.broadcast(df.sparkSession.createDataFrame(heads, f"{part} int, {carried} long"))
    return made.join(small, part).withColumn(out, (F.col(ID) - F.coalesce(start, carried)).cast("long")).select(*df.columns, out)


def hashed_rows(df: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """`count` rows in order of a seeded hash of row_id, numbered anew; each task keeps its first ones only."""
    at = order.fresh(df, "_hash")
    taken = df.withColumn(at, F.xxhash64(F.lit(seed), ID)).orderBy(at, ID).limit(count)
    return numbered(taken, [at, ID], ID).select(*df.columns)


def sample_rows(df: DataFrame, count: int, shuffle: bool = False, seed: int = 0, rows: int | None = None, draw: str = "numpy") -> DataFrame:
    """At most `count` rows: the first ones, or with shuffle a seeded draw in the order of the draw.

    draw: "numpy" gives what numpy's generator picks and holds up to 50 * count numbers on the driver; "hash" holds none.
    """
    n = rows if rows is not None else df.count()
    if not 0 < count < n:
        return df
    if not shuffle:
        return df.filter(F.col(ID) < count)
    if draw == "hash":
        return hashed_rows(df, count, seed)
    return gather(df, np.random.default_rng(seed).choice(n, size=count, replace=False).tolist())
