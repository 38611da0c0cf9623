"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Vectors are scaled to whole numbers, and each distinct one is fitted once. Tasks add up the centred scatter of their rows;
its sum is a matrix of the vectors' dimension, the only thing that the driver gets besides their sums. Its pivoted Cholesky
factor G (scatter = G G') is rotated from the right until its columns are orthogonal; the squares of their norms are then the
eigenvalues of the scatter, and the columns, normalised, its eigenvectors. As the factor and not the scatter is rotated,
small eigenvalues keep their accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.common import cut, discard, table

#: What entries are multiplied by before they are rounded down; components returned.
SCALE, COMPONENTS = 256, 4
SWEEPS = 60
_CHUNK = 4096


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """G of rank columns with G G' = scatter, up to the order of its rows lower triangular; the largest pivot is taken next."""
    size = len(scatter)
    factor, rest = np.zeros((size, size)), scatter.diagonal().copy()
    least = size * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    done = np.zeros(size, dtype=bool)
    for k in range(size):
        pivot = int(np.where(done, -1.0, rest).argmax())
        if done[pivot] or rest[pivot] <= least:
            return factor[:, :k]
        column = (scatter[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        column[done], column[pivot] = 0.0, np.sqrt(rest[pivot])
        done[pivot] = True
        factor[:, k] = column
        rest = rest - column**2
    return factor


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal. A round of a sweep rotates disjoint pairs at once."""
    size, rank = factor.shape
    g = np.concatenate([factor, np.zeros((size, rank % 2))], axis=1)
    most = np.finfo(float).eps * np.sqrt(size)
    half, turn = g.shape[1] // 2, np.arange(g.shape[1])
    for _ in range(SWEEPS if rank > 1 else 0):
        worst = 0.0
        for _ in range(len(turn) - 1):
            i, j = turn[:half], turn[half:][::-1]
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            norm = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), norm, out=np.zeros(half), where=norm > 0)
            worst, bent = max(worst, off.max()), off > most
            slope = np.divide(bb - aa, 2 * ab, out=np.zeros(half), where=bent)
            t = np.where(bent, np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1.0, slope)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * a - c * t * b, c * t * a + c * b
            turn = np.concatenate([turn[:1], turn[-1:], turn[1:-1]])
        if worst <= most:
            break
    return g[:, :rank]


@dataclass
class Whitener:
    """n fitted vectors with sums; components as columns, eigenvalues and their shares of the trace. `wide` tells whether whole
    numbers may be too long for 64 bits."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    wide: bool

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact."""
        kind = object if self.wide else np.int64
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ self.components / np.sqrt(self.eigenvalues)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, _CHUNK) for i in range(0, batch.num_rows, _CHUNK))


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and x, floor(SCALE * entry) of each entry as a long; rows with a null vector or with null or non-finite entries go,
    and those whose length is not the most frequent one (of equally frequent ones, the longest)."""
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.select("vec_id", "embedding").where(F.coalesce(whole, F.lit(False)))
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("embedding") == (size["n"] if size else 0)).select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE)).alias("x"))


def scatter(distinct: DataFrame, model: Whitener) -> DataFrame:
    """i, row: the rows of the sum of y y' over all x, where y is x less the mean."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _chunks(batches):
            y = shared.value.deviations(_matrix(batch.column("x"))).astype(float) / shared.value.n
            total = y.T @ y + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"i": rows.column("i")[:1], "row": pa.array([_matrix(rows.column("row").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

    return distinct.mapInArrow(part, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of distinct vectors (x); None if there are none. Components end at the rank of their scatter."""
    each = distinct.select(F.posexplode("x").alias("i", "v"))
    sums = each.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i").collect()
    if not sums:
        return None
    n, most = sums[0]["n"], max(max(-r["low"], r["high"]) for r in sums)
    model = Whitener(n, [int(r["s"]) for r in sums], np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), len(sums) * (2 * n * most) ** 2 >= 2**63)
    whole = np.zeros((len(sums), len(sums)))
    for r in scatter(distinct, model).toLocalIterator():
        whole[r["i"]] = r["row"]
    whole = (whole + whole.T) / 2
    turned = one_sided_jacobi(pivoted_cholesky(whole))
    norms = (turned * turned).sum(axis=0)
    best = np.argsort(-norms, kind="stable")[:components]
    unit = turned[:, best] / np.sqrt(norms[best])
    unit = unit * np.where(np.take_along_axis(unit, np.abs(unit).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
    model.components, model.eigenvalues, model.explained = unit, norms[best] / n, norms[best] / whole.trace()
    return model


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    shared, k = distinct.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in _chunks(batches):
            w = shared.value.whiten(shared.value.deviations(_matrix(batch.column("x"))))
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], names=["sums"])

    rows = distinct.mapInArrow(part, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in rows]) / model.n
    mean, second = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part and each component.

    Rows that are null or hold null or non-finite entries take no part, nor do those of another length than most. Entries
    beyond 64 bits when scaled count as the largest such number. A null vec_id is kept; repeated rows, and rows of one vec_id,
    get rows each, but equal vectors are fitted once. Components end at the rank of the vectors, so that one vector alone, or
    none, gives no rows. deviation is null where it is beyond 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(scaled(vectors))
    distinct = cut(rows.select("x").distinct())
    model = fit(distinct, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    shared, error, k = spark.sparkContext.broadcast(model), identity_error(distinct, model), len(model.eigenvalues)
    discard(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _chunks(batches):
            far = m.deviations(_matrix(batch.column("x")))
            squares = (far * far).sum(axis=1)
            exact = pa.array([v if v < 2**63 else None for v in squares.tolist()], pa.int64())
            at = pa.array(np.repeat(np.arange(len(far)), k))
            flat = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(far)), np.full(len(far) * k, m.n), m.whiten(far).ravel(), np.tile(m.explained, len(far)), np.full(len(far) * k, error)]
            number, n, white, explained, wrong = map(pa.array, flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), number, n, exact.take(at), white, explained, wrong], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
