"""Whole batches: making them from columns, looking into them, group numbers, and bytes to send.

A batch is a DataFrame with row_id; what holds for all of its rows is a plain dictionary beside it.
"""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators import order
from tallyweave.operators.verbs import ID

#: Bytes of a batch that may be made into one message; more raise an error.
MAX_BYTES = 256 << 20


def plain(value: Any) -> Any:
    """numpy arrays and scalars, at any depth of lists and dictionaries, as Python's own."""
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | np.ndarray):
        return [plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def columns_of(rows: Sequence[Mapping[str, Any]]) -> dict[str, list]:
    """A list for each key of the rows; every row must have the first one's keys."""
    keys = list(rows[0]) if rows else []
    if any(set(r) != set(keys) for r in rows):
        raise KeyError("rows with different keys")
    return {k: [r[k] for r in rows] for k in keys}


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence], others: Mapping[str, Sequence] | None = None) -> DataFrame:
    """A batch of columns of one length, arrays of more dimensions as nested ones; a name may stand on one side only."""
    both = dict(columns)
    for k, v in (others or {}).items():
        if k in both:
            raise ValueError(f"two columns {k!r}")
        both[k] = v
    sizes = {k: len(v) for k, v in both.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different lengths: {sizes}")
    table = pa.table({ID: pa.array(range(next(iter(sizes.values()), 0)), pa.int64())} | {k: pa.array(plain(list(v))) for k, v in both.items()})
    return spark.createDataFrame(table)


def prefixed(columns: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    """Names with the prefix, where they don't have it yet."""
    return {k if k.startswith(prefix) else prefix + k: v for k, v in columns.items()}


def appended(metrics: dict[str, list], new: Mapping[str, Any], prefix: str = "") -> dict[str, list]:
    """The lists with the new values at their ends; a list adds all it holds."""
    out = {k: list(v) for k, v in metrics.items()}
    for k, v in prefixed(new, prefix).items():
        out.setdefault(k, []).extend(v if isinstance(v, list) else [v])
    return out


def check_consistent(df: DataFrame) -> int:
    """The number of rows, after checking that row_id counts them from 0 without gaps or repeats."""
    got = df.agg(F.count("*").alias("n"), F.count(ID).alias("ids"), F.min(ID).alias("low"), F.max(ID).alias("high")).first()
    n = got["n"]
    if n and (got["ids"] < n or got["low"] != 0 or got["high"] != n - 1 or not df.groupBy(ID).count().filter("count > 1").isEmpty()):
        raise ValueError(f"row_id doesn't count {n} rows from 0")
    return n


def _size(c: str, kind: T.DataType):
    """Bytes of a value."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType | T.BooleanType):
        return F.size(c) * _width(kind.elementType)
    if isinstance(kind, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
        return F.lit(_width(kind))
    return F.octet_length(F.to_json(F.struct(c)))


def _width(kind: T.DataType) -> int:
    return {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}.get(type(kind), 8)


def info(df: DataFrame) -> DataFrame:
    """A row for each column: name, kind, rows, nulls, bytes, and the shortest and longest array. One pass over df."""
    stats = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        many = F.size(c) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast("int")
        stats.append(
            F.struct(
                F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("kind"), F.count("*").alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"),
                F.coalesce(F.sum(F.when(F.col(c).isNotNull(), _size(c, f.dataType)).cast("long")), F.lit(0)).alias("bytes"), F.min(F.when(F.col(c).isNotNull(), many)).alias("shortest"), F.max(many).alias("longest"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def group_numbers(df: DataFrame, label: str, out: str = "group") -> DataFrame:
    """Add 0, 1, 2, ... for the labels in their order; whole numbers stay themselves."""
    if isinstance(df.schema[label].dataType, T.IntegralType):
        return df.withColumn(out, F.col(label).cast("long"))
    other = order.fresh(df, "_label")
    named = order.numbered(df.select(F.col(label).alias(other)).distinct(), [other], out)
    return df.join(named, F.col(label).eqNullSafe(F.col(other))).select(*[c for c in df.columns if c != out], out)


def to_message(df: DataFrame, meta: Mapping[str, str] | None = None) -> bytes:
    """A bounded batch, with string metadata, as an Arrow stream; its size is checked first."""
    size = info(df).agg(F.sum("bytes").alias("b")).first()["b"] or 0
    if size > MAX_BYTES:
        raise ValueError(f"a message has at most {MAX_BYTES} bytes, not {size}; write a table instead")
    table = df.toArrow().replace_schema_metadata({k: v for k, v in (meta or {}).items()})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_message(spark: SparkSession, raw: bytes) -> tuple[DataFrame, dict[str, str]]:
    """(the batch, its metadata) of a message."""
    with pa.ipc.open_stream(io.BytesIO(raw)) as reader:
        table = reader.read_all()
    meta = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
    return spark.createDataFrame(table.replace_schema_metadata(None)), meta


def to_arrays(df: DataFrame, meta: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A bounded batch as numpy columns in row order, lists where lengths differ, and the metadata under their names."""
    size = info(df).agg(F.sum("bytes").alias("b")).first()["b"] or 0
    if size > MAX_BYTES:
        raise ValueError(f"arrays of at most {MAX_BYTES} bytes, not {size}")
    table = df.orderBy(ID).toArrow()
    out: dict[str, Any] = {}
    for name in table.column_names:
        values = table.column(name).to_pylist()
        lists = [v for v in values if isinstance(v, list)]
        ragged = lists and len({len(v) for v in lists} | ({None} if len(lists) < len(values) else set())) > 1
        out[name] = values if ragged else np.array(values)
    return out | dict(meta or {})


@dataclass(frozen=True)
class Batch:
    """A DataFrame with row_id and what holds for all of its rows."""

    frame: DataFrame
    meta: Mapping[str, Any] = field(default_factory=dict)

    def assign(self, **values: Any) -> Batch:
        """With more: a list or array is a column, a value for each row in order; anything else holds for all rows."""
        columns = {k: v for k, v in values.items() if isinstance(v, list | np.ndarray)}
        frame = self.frame
        if columns:
            more = from_columns(frame.sparkSession, columns)
            if check_consistent(frame) != more.count():
                raise ValueError("columns of another length than the batch")
            frame = frame.drop(*columns).join(more, ID)
        return Batch(frame, {**self.meta, **{k: v for k, v in values.items() if k not in columns}})

    def get(self, key: str, default: Any = None) -> Any:
        """A column as a list in row order, or what holds for all rows."""
        if key in self.frame.columns:
            return to_arrays(self.frame.select(*dict.fromkeys([ID, key])))[key]
        return self.meta.get(key, default)

    def pop(self, *keys: str) -> tuple[Batch, Batch]:
        """(the named columns and values, the rest); both keep row_id."""
        unknown = [k for k in keys if k not in self.frame.columns and k not in self.meta]
        if unknown:
            raise KeyError(f"not in the batch: {unknown}")
        mine = [k for k in keys if k in self.frame.columns and k != ID]
        return Batch(self.frame.select(ID, *mine), {k: v for k, v in self.meta.items() if k in keys}), Batch(self.frame.drop(*mine), {k: v for k, v in self.meta.items() if k not in keys})

    def chunks(self, parts: int) -> list[Batch]:
        """Contiguous equal batches, each lazy until it is asked for."""
        n = self.frame.count()
        if n % parts:
            raise ValueError(f"{n} rows don't divide into {parts} parts")
        size = n // parts
        return [Batch(self.frame.filter(F.col(ID).between(k * size, (k + 1) * size - 1)).withColumn(ID, F.col(ID) - k * size), dict(self.meta)) for k in range(parts)]
