"""Whitening of embeddings with exact sums by digit-slice products (operator 12).

Components become whole numbers, x = floor(scale * c) + offset. A task splits its vectors into
limbs of LIMB bits, so that float64 matrix products of limbs are exact sums of whole numbers,
and recombines them as big integers; a column of ones gives the number of rows and the sums of
the dimensions along with the products. Spark adds up the tasks' products, cut into digits that
sum exactly as decimals, by (row, column) of the matrix; the driver gets (dims + 1) * (dims + 2) / 2
rows, whatever the data. The covariance is centred in whole numbers before it is divided, then
decomposed.

A second pass projects each vector, from n * x - S in whole numbers; its rows are written once,
and the covariance of the whitened values is measured on them (`covar_pop`, which centres
as it goes).

Defined results: vectors that are null or hold null, NaN or infinite components are dropped.
Rows without an id and rows that repeat one are rows like others. Vectors whose length isn't
the most common one (of several, the smallest) take no part, nor do empty ones. Whole numbers that
no long holds count as the largest or smallest long. A component without variance beyond rounding has whitened 0
and stays out of the identity error. Where all vectors are equal, `explained` is 0. A deviation
of more than 38 digits is null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, new_name, trimmed

#: Bits of a limb: products are under 2**32, and sums of ROWS of them under 2**53.
LIMB = 16
ROWS = 1 << 20
#: Rows whose products are summed up in longs before they go over to big integers.
LONG_ROWS = 1 << 26
#: Bytes of vectors that are multiplied at once.
BLOCK = 8 << 20
#: Bits of the digits in which tasks hand over their sums, lowest first.
DIGIT, DIGITS = 48, 4
_LONGEST = (1 << 63) - 1


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # per dimension, exact
    components: np.ndarray  # a unit eigenvector a row, by falling eigenvalue
    values: np.ndarray  # eigenvalues
    trace: float

    @property
    def kept(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > self.trace * len(self.sums) * 2.0**-52


def whole_vectors(df: DataFrame, vec_col: str, scale: int, offset: int, name: str) -> DataFrame:
    """df's rows of finite vectors, with `name`: floor(scale * component) + offset as longs."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    most, least = _LONGEST - max(offset, 0), -_LONGEST - 1 - min(offset, 0)
    whole = F.transform(vec_col, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(most)), F.lit(least)) + F.lit(offset))
    return df.filter(F.col(vec_col).isNotNull()).filter(~bad).withColumn(name, whole)


def limbs(x: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Arrays a with x = sum of a[k] * 2**(bits * k); all but the last are in [0, 2**bits), the last is at most 2**bits from 0."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append(x & ((1 << bits) - 1))
        x = x >> bits
    return [*out, x]


class Products:
    """Exact sums of x x^T over rows with a leading 1."""

    def __init__(self, dims: int) -> None:
        self.total = np.zeros((dims + 1, dims + 1), object)
        self.held: dict[int, np.ndarray] = {}  # by shift, in longs
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        """Rows of whole numbers, ROWS at most."""
        parts = [np.column_stack([np.full(len(x), float(k == 0)), a.astype(np.float64)]) for k, a in enumerate(limbs(x))]
        if self.rows + len(x) > LONG_ROWS:
            self.flush()
        self.rows += len(x)
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                g = (a.T @ parts[j]).astype(np.int64)
                held = self.held.setdefault(LIMB * (i + j), np.zeros_like(g))
                held += g if i == j else g + g.T

    def flush(self) -> None:
        for shift, g in self.held.items():
            self.total += g.astype(object) * (1 << shift)
        self.held, self.rows = {}, 0


def digits(value: int) -> list[int]:
    """The DIGITS digits of a big integer, lowest first; the last one has its sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _blocks(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of longs) for runs of a batch's vectors, all of `dims` components."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(1, min(ROWS, BLOCK // (8 * dims)))
    for at in range(0, len(flat), step):
        yield at, flat[at : at + step]


def _summing(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Products(dims)
        for batch in batches:
            for _, x in _blocks(batch, 0, dims):
                made.add(x)
        made.flush()
        if made.total[0, 0]:
            rows = [(i, j, *digits(made.total[i, j])) for i in range(dims + 1) for j in range(i, dims + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "j", *(f"d{k}" for k in range(DIGITS))])

    return run


def decompose(total: np.ndarray) -> Whitening:
    """From the exact products of rows with a leading 1."""
    n, sums = int(total[0, 0]), [int(v) for v in total[0, 1:]]
    s = np.array(sums, object)
    centred = n * total[1:, 1:] - np.outer(s, s)
    cov = np.array([[int(v) / (n * n) for v in row] for row in centred])  # of whole numbers, rounded once
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order].T
    turn = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return Whitening(n, sums, vectors * turn[:, None], np.maximum(values[order], 0.0), float(sum(int(centred[i, i]) for i in range(len(sums))) / (n * n)))


def fit(rows: DataFrame, whole: str, dims: int) -> Whitening | None:
    """The whitening of a DataFrame's vectors of `dims` longs; None without rows."""
    parts = rows.select(whole).mapInArrow(trimmed(_summing(dims)), "i long, j long, " + ", ".join(f"d{k} long" for k in range(DIGITS)))
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"d{k}").cast("decimal(19,0)").cast("decimal(38,0)")).alias(f"d{k}") for k in range(DIGITS)])
    total = np.zeros((dims + 1, dims + 1), object)
    for r in sums.collect():  # as many rows as the matrix has entries
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = sum(int(r[f"d{k}"]) << (DIGIT * k) for k in range(DIGITS))
    return decompose(total) if total[0, 0] else None


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n * x - sums as float64, each entry rounded once, and the sum of its squares a row, exact."""
    far = n * max(-int(x.min()), int(x.max()), 0) + max(map(abs, sums))
    if far >= 1 << 62:
        d = n * x.astype(object) - np.array(sums, object)
        return d.astype(np.float64), [int(v) for v in (d * d).sum(1)]
    d = n * x - np.array(sums, np.int64)
    if x.shape[1] * far * far < 1 << 63:
        return d.astype(np.float64), (d * d).sum(1).tolist()
    parts, squares = limbs(d, 20), np.zeros(len(d), object)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            squares += (a * parts[j]).sum(1).astype(object) * ((1 + (i != j)) << (20 * (i + j)))
    return d.astype(np.float64), squares.tolist()


def _projecting(found: Whitening, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = min(most, len(found.sums))
        scale = np.where(found.kept[:top], 1 / np.sqrt(np.where(found.kept[:top], found.values[:top], 1)), 0)
        onto = (found.components[:top] * scale[:, None]).T
        for batch in batches:
            for at, x in _blocks(batch, 1, len(found.sums)):
                d, squares = deviations(x, found.n, found.sums)
                white = (d / found.n) @ onto
                values = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), top).cast(schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(list(map(str, squares)), pa.string()), values], schema=schema)

    return run


def whiten(df: DataFrame, *, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error): a row a vector."""
    spark = df.sparkSession
    importable(spark)
    own = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec"))
    whole = whole_vectors(own, "_vec", scale, offset, "_x").select("_id", "_x")
    lengths = whole.groupBy(F.size("_x").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    shape = f"{id_col} long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    found = None
    if lengths is not None:
        whole = whole.filter(F.size("_x") == lengths["dims"])
        found = fit(whole, "_x", lengths["dims"])
    if found is None:
        return spark.createDataFrame([], shape)
    top = min(components, lengths["dims"])
    schema = pa.schema([("_id", pa.int64()), ("squares", pa.string()), ("whitened", pa.list_(pa.float64()))])
    made = materialize(whole.mapInArrow(trimmed(_projecting(found, components, schema)), "_id long, squares string, whitened array<double>"), "whitened")
    at = [k for k in range(top) if found.kept[k]]
    entries = [(a, b) for a in at for b in at if a <= b]
    error = 0.0
    if entries:
        measured = made.agg(*[F.covar_pop(F.get("whitened", F.lit(a)), F.get("whitened", F.lit(b))).alias(f"c{a}_{b}") for a, b in entries]).first()
        error = max(abs(measured[f"c{a}_{b}"] - (a == b)) for a, b in entries)
    share = [float(v / found.trace) if found.trace else 0.0 for v in found.values[:top]]
    return made.select(
        F.col("_id").alias(id_col), F.lit(found.n).cast("long").alias("n"), F.col("squares").try_cast("decimal(38,0)").alias("deviation"), "whitened",
        F.array(*[F.lit(v) for v in share]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def component_rows(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row a vector and component, components numbered from 1; deviations that no long holds are null."""
    at = new_name(found, "_at")
    long = found.select("*", F.posexplode("whitened").alias(at, at + "_w"))
    return long.select(
        id_col, (F.col(at) + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), F.col(at + "_w").alias("whitened"), F.get("explained", F.col(at)).alias("explained"), "identity_error",
    )
