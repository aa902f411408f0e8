"""Embedding whitening by polarisation: exact variances of dimensions and of sums of two dimensions give the covariance.

Entries become integers, so that every sum is exact whatever the order and number of the tasks. A task emits a row for
each dimension and pair of dimensions, summed before the shuffle; what reaches the driver is bounded by the dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, table, written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Scaled entries from this on have no exact place in the sums.
TOO_LARGE = 2.0**50
EXACT = T.DecimalType(38, 0)
SUMS = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("total", EXACT)])


@dataclass(frozen=True)
class Fit:
    """Of all vectors of one length: their number, sums by dimension, components (in columns) and eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[int, ...]:
        return tuple(s // self.n for s in self.sums)

    @property
    def live(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector of the rows whose vector is neither null nor holds a null or non-finite entry."""
    kept = df.select(quoted(key).alias("key"), quoted(vector).alias("vector"))
    if kept.schema["vector"].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        kept = kept.withColumn("vector", F.col("vector").cast("array<double>"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return kept.filter(F.col("vector").isNotNull() & ~F.exists("vector", odd) & (F.size("vector") > 0))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in batch: the length, the rows' places and their integers, a row for each dimension."""
    column = batch.column("vector")
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        scaled = np.floor(flat[starts[at][:, None] + np.arange(size)].astype(np.float64) * SCALE)
        if len(at) and np.abs(scaled).max() >= TOO_LARGE:
            raise ValueError(f"an entry is beyond {TOO_LARGE / SCALE:g}")
        yield int(size), at, np.ascontiguousarray(scaled.T).astype(np.int64) + OFFSET


def squares(x: np.ndarray) -> int | np.ndarray:
    """Exact sums of the squares of each row of x."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(1, x.shape[-1]) < 2**62:
        return np.einsum("ij,ij->i", x, x)
    return np.array([sum(v * v for v in row) for row in x.tolist()], object)


def rows_of(sums: dict[tuple[int, int, int], int]) -> Iterator[pa.RecordBatch]:
    keys = list(sums)
    if keys:
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(int(sums[k])) for k in keys], pa.decimal128(38, 0))], names=SUMS.names)


def plain_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, i, -1): the sum of dimension i; (size, -1, -1): how many vectors."""
    sums: dict[tuple[int, int, int], int] = {}
    for b in batches:
        for size, at, x in matrices(b):
            sums[size, -1, -1] = sums.get((size, -1, -1), 0) + len(at)
            for i, row in enumerate(x):
                sums[size, i, -1] = sums.get((size, i, -1), 0) + int(row.sum())
    yield from rows_of(sums)


def gathered(df: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Totals of all tasks, by size: as many as there are pairs of dimensions at most."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in df.groupBy("size", "i", "j").agg(F.sum("total").cast(EXACT).alias("total")).collect():
        out.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["total"])
    return out


def covariance(n: int, at: dict[tuple[int, int], int], d: int) -> np.ndarray:
    """From the sums (i, -1), squares (i, i) and squares of the sums of two dimensions (i, j), each exact: n * n times
    the variances are integers, half the difference of variances is a covariance, and only the last division rounds."""
    var = [n * at[i, i] - at[i, -1] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = var[i] / (n * n)
        for j in range(i + 1, d):
            both = n * at[i, j] - (at[i, -1] + at[j, -1]) ** 2
            out[i, j] = out[j, i] = (both - var[i] - var[j]) / (2 * n * n)
    return out


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> dict[int, Fit]:
    """By length, the fit over all vectors of df of that length. Vectors of unlike lengths do not mix; null vectors and
    those with null or non-finite entries are left out, repeated rows count each; an empty table has no fit."""
    good = vectors(df, key, vector)
    first = gathered(good.mapInArrow(plain_sums, SUMS))
    sums = {size: tuple(t[i, -1] for i in range(size)) for size, t in first.items()}
    counts = {size: t[-1, -1] for size, t in first.items()}
    held = df.sparkSession.sparkContext.broadcast({size: np.array([s // counts[size] for s in sums[size]]) for size in sums})

    def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of values less the whole part of their mean: (i, -1) sums, (i, i) squares, (i, j) squares of sums of two."""
        out: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for size, _, x in matrices(b):
                y = x - held.value[size][:, None]
                plain, own = y.sum(axis=1), squares(y)
                for i in range(size):
                    pairs = squares(y[i + 1 :] + y[i])
                    for j, v in ((-1, plain[i]), (i, own[i]), *zip(range(i + 1, size), pairs, strict=True)):
                        out[size, i, j] = out.get((size, i, j), 0) + int(v)
        yield from rows_of(out)

    fits = {}
    for size, at in (gathered(good.mapInArrow(pair_sums, SUMS)) if sums else {}).items():
        v = covariance(counts[size], at, size)
        values, axes = np.linalg.eigh(v)
        axes = axes[:, ::-1] * np.where(axes[np.abs(axes).argmax(axis=0), range(size)] < 0, -1, 1)[::-1]
        fits[size] = Fit(counts[size], sums[size], axes, values[::-1].copy(), float(np.trace(v)))
    return fits


def whiten(df: DataFrame, fits: dict[int, Fit], key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each vector that `vectors` keeps: key, size, deviation, deviation_exact and whitened (an array).

    Deviation is the exact sum of (n * x - S) squared: null in the long beyond its range, always there in
    deviation_exact. Whitened has an entry for each component, as many as there are dimensions at most, in the order of
    falling variance; null for those without variance (one vector only, or all alike). Null keys, ties and repeated
    rows are kept; other columns don't matter; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at, x in matrices(b):
                f = held.value[size]
                centre = np.array(f.centre)
                rest = np.array([s - f.n * c for s, c in zip(f.sums, f.centre, strict=True)])
                y = x - centre[:, None]
                exact = f.n * int(np.abs(y).max(initial=0)) + f.n < 2**62
                a = (f.n * y - rest[:, None]) if exact else np.array([[f.n * v - int(r) for v in row] for row, r in zip(y.tolist(), rest, strict=True)], object)
                deviation = [int(v) for v in squares(np.ascontiguousarray(a.T))]
                k, live = min(components, size), f.live[:components]
                made = (a / f.n).astype(float).T @ f.axes[:, :k] / np.sqrt(np.where(live, f.values[:k], 1))
                white = pa.array([[v if ok else None for v, ok in zip(row, live, strict=True)] for row in made.tolist()], pa.list_(pa.float64()))
                longs = pa.array([v if v < 2**63 else None for v in deviation], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at)), pa.array([size] * len(at), pa.int32()), longs, pa.array(map(Decimal, deviation), pa.decimal128(38, 0)), white], names=["key", "size", "deviation", "deviation_exact", "whitened"])

    good = vectors(df, key, vector)
    fields = [("key", good.schema["key"].dataType), ("size", T.IntegerType()), ("deviation", T.LongType()), ("deviation_exact", EXACT), ("whitened", T.ArrayType(T.DoubleType()))]
    return good.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def identity_errors(white: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Size and identity_error of what `whiten` returns: how far its covariance is from the identity, at worst. Components
    without variance don't count; where none has any the error is 0."""
    w = [F.get("whitened", F.lit(k)) for k in range(components)]
    far = [F.abs(F.covar_pop(w[i], w[j]) - float(i == j)) for i in range(components) for j in range(i, components)]
    return white.groupBy("size").agg(F.coalesce(F.greatest(*far), F.lit(0.0)).alias("identity_error"))


def components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error,
    deviation_exact. The handling is that of `fit` and `whiten`; explained is null where no dimension varies."""
    spark = df.sparkSession
    fits = fit(df, key, vector)
    white = written(whiten(df, fits, key, vector, count), "whitened")
    facts = [(size, f.n, [float(v) / f.trace if f.trace else None for v in np.maximum(f.values[:count], 0)]) for size, f in fits.items()]
    # A row for each length of vectors.
    by_size = spark.createDataFrame(facts, "size int, n long, shares array<double>").join(identity_errors(white, count), "size")
    rows = white.join(F.broadcast(by_size), "size").select("*", F.posexplode("whitened").alias("at", "value"))
    return rows.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("shares", F.col("at")).alias("explained"), "identity_error", "deviation_exact",
    )


def query(spark, sf_dir):
    return components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
