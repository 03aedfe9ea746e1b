"""Whitening of embeddings along their leading components, found by LOBPCG.

Entries are put on a grid (floor of SCALE times the entry), so that counts, sums and deviations are exact integers. The
fit list holds each distinct grid vector once. The covariance V of the fit list is never formed: each round, tasks
centre their rows y and add up y (y B) for the columns of a narrow block B, partial sums meet by cell, and the driver
gets d x b numbers, whatever the number of rows. B is an orthonormal basis of the iterate, its residuals and the
directions of the last step; Rayleigh-Ritz on it gives the next iterate. Products are fresh each round, so the residuals
|V x - e x| are certified by the data themselves, and rounds go on until those of all wanted components are at most
TOLERANCE times the largest eigenvalue (or stand still at the limit of rounding, at most STALLED times it).

Copies of one vector, however many, combine before the exchange of the fit list, which is written once to the shared
folder and read by every round. Memory is one Arrow batch and d x b sums a task.

Edge cases: rows whose vector is null or holds a null or a number that is not finite are dropped, as are vectors of
another length than the most frequent one (of equally frequent lengths, the longest) and empty vectors. Rows that repeat
are whitened each; ids may be null. Components of no variance (at most NONE times the largest eigenvalue) cannot be
scaled to one and are not returned, so one single vector gives no row. A deviation beyond 64 bits is null. Columns other than id and vector are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretable.llm.common import Scratch, ship

SCALE = 256
#: Components, and columns that the iterate has besides: they make the wanted ones settle sooner.
COMPONENTS, GUARD = 4, 6
TOLERANCE, STALLED, NONE = 1e-14, 1e-11, 1e-12
MOST_ROUNDS, PATIENCE = 400, 5


@dataclass(frozen=True)
class Spectrum:
    """The leading components: eigenvalues, unit vectors as columns, residual norms, rounds that it took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def on_grid(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that are whole; x: array<long>."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of what part gives for some of them: a flat array, added up in tasks, then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(matrix(batch.column(0), d))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "s"])

    cells = fit.select("x").mapInArrow(run, f"cell int, s {kind}").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(cells), dtype=np.float64 if kind == "double" else object)
    for r in cells:
        out[r.cell] = r.s
    return out


def orthonormal(iterate: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A basis of both; its first columns span the iterate."""
    first = np.linalg.qr(iterate)[0]
    for _ in range(2):
        others = others - first @ (first.T @ others)
        sizes = np.linalg.norm(others, axis=0)
        others = others[:, sizes > 0] / sizes[sizes > 0]
    if others.shape[1] == 0:
        return first
    u, s, _ = np.linalg.svd(others, full_matrices=False)
    u = u[:, s > 1e-9 * s[0]][:, : first.shape[0] - first.shape[1]]
    u = u - first @ (first.T @ u)
    return np.hstack([first, np.linalg.qr(u)[0]])


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> Spectrum:
    """The k leading eigenpairs of a symmetric operator of d dimensions, of which only products with blocks are known."""
    m = min(d, k + guard)
    k = min(k, d)
    iterate, others = np.random.default_rng(0).standard_normal((d, m)), np.empty((d, 0))
    best, since = None, 0
    for i in range(1, rounds + 1):
        basis = orthonormal(iterate, others)
        product = times(basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        iterate, image = basis @ turn, product @ turn
        residual = image - iterate * values
        now = Spectrum(values[:k], iterate[:, :k], np.linalg.norm(residual[:, :k], axis=0), i)
        limit = max(values[0], 0.0)
        if best is None or now.residuals.max() < 0.5 * best.residuals.max():
            best, since = now, 0
        else:
            since += 1
        if now.residuals.max() <= tolerance * limit:
            return now
        if since >= PATIENCE and best.residuals.max() <= STALLED * limit:
            return best
        others = np.hstack([residual, basis[:, m:] @ turn[m:]])
    raise RuntimeError(f"residuals of {best.residuals.max():.3g} after {rounds} rounds")


def whiten(vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each whole row of vectors and each component: id, component (from 1), n, deviation, whitened, explained,
    identity_error, residual (of the component, over the largest eigenvalue)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = on_grid(vectors, id_col, vec_col, scale)
    schema = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()), T.StructField("residual", T.DoubleType()),
    ])
    fit = Scratch(spark, "whitening").store(rows.select("x").distinct(), "fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d, n = length["d"], length["count"]
    fit, rows = fit.where(F.size("x") == d), rows.where(F.size("x") == d)
    halves = summed(fit, d, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long")
    sums = [int(hi) * (1 << 32) + int(lo) for hi, lo in zip(halves[:d], halves[d:], strict=True)]
    mean = np.array([s / n for s in sums])
    trace = float(summed(fit, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return (y.T @ (y @ block)).ravel()

        return summed(fit, d, part).reshape(block.shape) / n

    found = lobpcg(times, d, components) if trace > 0 else Spectrum(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    some = found.values > NONE * max(found.values.max(initial=0.0), np.finfo(float).tiny)
    values, residuals = found.values[some], found.residuals[some] / found.values.max(initial=1.0)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = found.vectors[:, some] / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    seen = summed(fit, d, moments) / n
    error = float(np.abs(seen[: k * k].reshape(k, k) - np.outer(seen[k * k :], seen[k * k :]) - np.eye(k)).max())
    explained = values / trace
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (m := batch.num_rows):
                continue
            x = matrix(batch.column(1), d)
            z = (x - mean) @ turn
            # 64-bit integers wrap, so the sum is right whenever it fits; about how large it is tells whether it does
            y = n * x - wrapped
            deviation, about = (y * y).sum(axis=1), ((float(n) * (x - mean)) ** 2).sum(axis=1)
            deviation = pa.array(np.repeat(deviation, k), mask=np.repeat(about > 9.2e18, k))
            each = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, dtype=np.int64), deviation, z.ravel(), np.tile(explained, m), np.full(m * k, error), np.tile(residuals, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), *(c if isinstance(c, pa.Array) else pa.array(c) for c in each)], names=schema.names)

    return rows.mapInArrow(run, schema)
