"""PCA whitening of embeddings from exact integer cross-products.

Method: bit-sliced scatter. Entries become integers, shifted by their
dimension's minimum. The bit planes of each dimension are packed across rows
into 64-bit words; the AND of two planes, its set bits counted and weighted by
both planes' values, gives the exact sum of products of two dimensions. These
sums are centred as integers (n times the products' sum less the product of the
sums), so nothing is lost to rounding before ``eigh``.

Tasks reduce their rows to one number per pair of dimensions; Spark adds them
up. The driver holds those d x d sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship, stage

#: Rows whose bit planes are packed at a time.
ROWS = 8192
#: Entries beyond 2**46 have no exact place in the integers used here.
LIMIT = float(1 << 46)
#: Eigenvalues below this share of the trace count as zero.
ZERO = 1e-12
_BIG = pa.decimal128(38, 0)


def quantised(df: DataFrame, vector_col: str, scale: int, offset: int, keep: list) -> DataFrame:
    """``keep`` and ``x`` (array of longs) of the rows that have a usable vector."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    rows = df.select(*keep, F.when(fine, v).alias("v")).where("v is not null")
    return rows.select(*[c for c in rows.columns if c != "v"], F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def scatter(x: np.ndarray, widths: list[int]) -> np.ndarray:
    """Sums over rows of the products of every two columns of ``x`` (not
    negative, ``widths`` bits), in the upper triangle; at most ``ROWS`` rows."""
    dims = len(widths)
    kind = np.int64 if 2 * max(widths, default=0) + ROWS.bit_length() < 62 else object
    out = np.zeros((dims, dims), kind)
    used = [i for i in range(dims) if widths[i]]
    planes = [(i, a) for i in used for a in range(widths[i])]
    if not planes:
        return out
    bits = np.empty((len(planes), x.shape[0]), np.uint8)
    for p, (i, a) in enumerate(planes):
        bits[p] = (x[:, i] >> a) & 1
    packed = np.packbits(bits, axis=1)
    words = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
    starts = np.cumsum([0] + [widths[i] for i in used[:-1]])
    weight = np.array([1 << a for _, a in planes], kind)
    for k, i in enumerate(used):
        first = starts[k]
        for a in range(widths[i]):
            met = np.bitwise_count(words[first + a] & words[first:]).sum(axis=1, dtype=np.int64)
            sums = np.add.reduceat(met.astype(kind, copy=False) * weight[first:], starts[k:] - first)
            out[i, used[k:]] += sums * (1 << a)
    return out


@dataclass
class Whitening:
    """A fitted whitening: ``scaled`` is dims x k (unit eigenvectors over the
    square roots of their eigenvalues), ``low`` the shift and ``sums`` the sums of
    the shifted entries over the ``n`` distinct vectors."""

    n: int
    low: list[int]
    high: list[int]
    sums: list[int]
    scaled: np.ndarray
    explained: list[float]
    eigenvalues: list[float]
    identity_error: float
    scale: int
    offset: int

    @property
    def dims(self) -> int:
        return len(self.low)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x less the sums, exact."""
        reach = self.n * max((h - a for a, h in zip(self.low, self.high)), default=0)
        kind = np.int64 if reach.bit_length() < 62 else object
        return (x - np.array(self.low, np.int64)).astype(kind) * self.n - np.array(self.sums, kind)

    def squares(self, z: np.ndarray) -> list:
        """Exact sums of squares by row."""
        reach = self.n * max((h - a for a, h in zip(self.low, self.high)), default=0)
        if z.dtype != object and (reach * reach * max(1, self.dims)).bit_length() < 63:
            return (z * z).sum(axis=1)
        return [sum(int(c) * int(c) for c in row) for row in z]

    def project(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / self.n) @ self.scaled


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Fit on the distinct quantised vectors; None where there are none. Vectors
    of another length than the most frequent one among the distinct vectors (the
    longest on ties) are left out. Components whose eigenvalue is zero get
    ``whitened`` and ``explained`` 0 and take no part in ``identity_error``."""
    spark = df.sparkSession
    ship(spark)
    distinct = stage(quantised(df, vector_col, scale, offset, []).distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    if not dims:
        return None
    rows = distinct.where(F.size("x") == dims)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            if len(x):
                a, b = x.min(axis=0), x.max(axis=0)
                low, high = (a, b) if n == 0 else (np.minimum(low, a), np.maximum(high, b))
                n += len(x)
                total = total + (x - a).sum(axis=0, dtype=object) + a.astype(object) * len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims), pa.array(low), pa.array(high),
                                              pa.array([Decimal(t) for t in total], _BIG)], ["i", "n", "lo", "hi", "s"])

    per_dim = rows.mapInArrow(bounds, "i long, n long, lo long, hi long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s")).collect()
    per_dim.sort(key=lambda r: r["i"])
    n, low, high = per_dim[0]["n"], [r["lo"] for r in per_dim], [r["hi"] for r in per_dim]
    sums = [int(r["s"]) - n * r["lo"] for r in per_dim]
    widths = [(b - a).bit_length() for a, b in zip(low, high)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = np.zeros((dims, dims), object), np.array(low, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                total = total + scatter(x[at:at + ROWS] - shift, widths)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([Decimal(int(t)) for t in total[i, j]], _BIG)], ["i", "j", "s"])

    pairs = rows.mapInArrow(cross, "i long, j long, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros((dims, dims))
    for r in pairs:
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["s"]) - sums[i] * sums[j]) / (n * n)  # integers until the one division
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(cov))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    real = values > ZERO * trace
    model = Whitening(n, low, high, sums, np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0),
                      [float(v) / trace if ok else 0.0 for v, ok in zip(values, real)], [float(v) for v in values], 0.0, scale, offset)
    model.identity_error = _identity_error(rows, model, real)
    return model


def _identity_error(rows: DataFrame, model: Whitening, real: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the
    identity, measured on all vectors of the fit (their mean is zero up to
    rounding, and is taken off)."""
    dims, k = model.dims, int(real.sum())
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.project(model.deviations(_matrix(batch.column(0), dims)))[:, real]
            total += np.vstack([w.sum(axis=0), w.T @ w])
        i, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    sums = np.zeros((k + 1, k))
    for r in rows.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = r["s"]
    mean = sums[0] / model.n
    return float(np.abs(sums[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``id``, ``component`` (int, from
    1), ``n`` (long), ``deviation`` (decimal(38,0)), ``whitened``, ``explained``,
    ``identity_error`` (double)."""
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(f"`{id_col}`").alias("id"))
    kind = source.schema.fields[0].dataType
    schema = f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    rows = quantised(df, vector_col, model.scale, model.offset, [F.col(f"`{id_col}`").alias("id")]).where(F.size("x") == model.dims)
    k, id_type = model.scaled.shape[1], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                m = batch.num_rows
                z = model.deviations(_matrix(batch.column(1), model.dims))
                squares = model.squares(z)
                squares = pa.array(squares).cast(_BIG) if isinstance(squares, np.ndarray) else pa.array([Decimal(s) for s in squares], _BIG)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).cast(id_type).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    squares.take(each), pa.array(model.project(z).ravel()), pa.array(np.tile(np.array(model.explained), m)),
                    pa.array(np.full(m * k, model.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and transform all its rows.

    Each entry c, as double, becomes the integer floor(scale * c) + offset.
    Left out are rows whose vector is null or empty, holds a null, NaN, infinite
    or (beyond 2**46) not exactly representable entry, or has another length than
    most. Repeated vectors count once in the fit, however many rows hold one (a
    task sends each once), and every row is transformed; a null id is an id like
    any other. Other columns are not read, whatever their names. One vector
    alone has no spread: ``whitened`` 0. An empty table gives no rows."""
    return transform(df, fit(df, vector_col, components, scale, offset), id_col, vector_col)
