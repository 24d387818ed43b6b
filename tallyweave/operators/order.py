"""Global order without a global task: row numbers, prefix sums and carried values over range partitions.

Rows are range-partitioned by their order, sorted and written with their place (partition and position
within it). What one partition needs to know of those before it is a row a partition, which is
summed up on the driver and sent back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.scratch import materialize

#: Bits of monotonically_increasing_id that hold a row's position within its partition.
_POSITION = 33


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def placed(df: DataFrame, order: Sequence[str | Column], name: str = "ordered") -> tuple[DataFrame, str, str]:
    """df in order, written, with two more columns: the partition of a row and its position there; and their names."""
    part, at = fresh(df, "_part"), fresh(df, "_at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = dealt.withColumn(part, F.shiftright(at, _POSITION).cast("int")).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << _POSITION) - 1)))
    return materialize(rows, name), part, at


def starts(totals: DataFrame, part: str, total: str) -> DataFrame:
    """(part, total): for each partition the sum of the totals before it. totals: a row a partition."""
    at, made = 0, []
    for r in sorted(totals.collect(), key=lambda r: r[part]):
        made.append((r[part], at))
        at += r[total] or 0
    return F.broadcast(totals.sparkSession.createDataFrame(made, f"{part} int, {total} long"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... in the given order, ties in any; a column of that name is replaced."""
    rows, part, at = placed(df, order)
    before = fresh(rows, "_before")
    counts = rows.groupBy(part).agg(F.count("*").alias(before))
    joined = rows.join(starts(counts, part, before), part)
    return joined.withColumn(name, F.col(before) + F.col(at)).select(*[c for c in df.columns if c != name], name)


def prefix_sums(df: DataFrame, order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before it in the given order, a double."""
    given = fresh(df, "_value")
    rows, part, at = placed(df.withColumn(given, value.cast("double")), order)
    total, within, before = (fresh(rows, x) for x in ("_total", "_within", "_before"))
    made = []
    sofar = 0.0
    for r in sorted(rows.groupBy(part).agg(F.sum(given).alias(total)).collect(), key=lambda r: r[part]):  # a row a partition
        made.append((r[part], sofar))
        sofar += r[total] or 0.0
    w = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(within, F.coalesce(F.sum(given).over(w), F.lit(0.0)))
    joined = summed.join(F.broadcast(df.sparkSession.createDataFrame(made, f"{part} int, {before} double")), part)
    return joined.withColumn(name, F.col(before) + F.col(within)).select(*[c for c in df.columns if c != name], name)


def carried(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """df with `name`: the last value that isn't null, up to the row itself in the given order."""
    rows, part, at = placed(df, order)
    last, before = fresh(rows, "_last"), fresh(rows, "_before")
    ends = rows.filter(F.col(value).isNotNull()).groupBy(part).agg(F.max_by(value, at).alias(last))
    found = {r[part]: r[last] for r in ends.collect()}  # a row a partition
    now, made = None, []
    for p in range(max(found, default=-1) + 2):
        made.append((p, now))
        now = found.get(p, now)
    kind = df.schema[value].dataType.simpleString()
    small = df.sparkSession.createDataFrame([x for x in made if x[1] is not None], f"{part} int, {before} {kind}")
    final = made[-1][1] if made else None
    w = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn(last, F.last(value, ignorenulls=True).over(w)).join(F.broadcast(small), part, "left")
    beyond = F.when(F.col(part) >= len(made), F.lit(final))  # partitions after the last value
    return own.withColumn(name, F.coalesce(last, before, beyond)).select(*[c for c in df.columns if c != name], name)
