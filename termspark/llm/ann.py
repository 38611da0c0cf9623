"""Approximate nearest neighbours by score-aware anisotropic quantisation.

A vector is cut into pairs of dimensions, each coded by one of sixteen centres (four bits). Centres and codes minimise a
loss in which the residual parallel to the vector counts ETA times the one across it, as only the parallel part shifts the
inner products of queries that the vector answers. The smallest distance is the largest q.x - |x|^2 / 2, so a scan adds up
table entries for q.x, looked up by bytes of two codes, and the stored exact norms.

How far a code is from its vector depends on the rows: in tight clusters, or far from the origin, many rows share their codes.
So each row keeps the distance to its code, and what the code leaves over in sixteen bits a dimension with the distance that is
left then. A distance is known up to these: the best guesses of a query bound its nearest rows, rows that their codes place
beyond the bound are out, and the finer codes decide which of the others are candidates. All rows that can be among the nearest
are, and they are ranked again by their exact distance.

Equal vectors are one candidate with its smallest ids, so copies cost nothing. Queries meet the rows in blocks: codes are
dealt to buckets once and stay there, and each block of queries is sent to all buckets, as queries are few and codes many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.llm.common import cut, partitions, table

#: The centres are fitted on so many vectors at most, those with the smallest hashes.
FIT_ROWS = 8192
CENTRES, PER_CODE = 16, 2
ROUNDS = 8
#: Threshold T of the score-aware loss: inner products above T times the norm matter. ETA = (d - 1) T^2 / (1 - T^2).
THRESHOLD = 0.2
QUERY_BLOCK, ROW_BLOCK = 256, 4096
#: Guesses of each query and block that bound its nearest rows; more make the bound tighter and lose or add no row.
CANDIDATES = 64
#: Rounding of distances from tables and from fine codes, as shares of the lengths of both vectors: the roots of those of squares.
COARSE_ROUNDING, ROUNDING = 2e-3, 1e-6
FINE = 32767
#: Candidates that a task collects before it hands them on.
HELD = 1 << 20


@dataclass
class Quantiser:
    dim: int
    centres: np.ndarray  # (codes, CENTRES, PER_CODE)
    eta: float

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(rows, codes, PER_CODE), padded with zeros."""
        n = len(self.centres)
        return np.pad(x, ((0, 0), (0, n * PER_CODE - x.shape[1]))).reshape(len(x), n, PER_CODE)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes that minimise the loss, one code at a time given the others; starts from the nearest centres."""
        parts = self.cut(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        across = ((parts[:, :, None, :] - self.centres[None]) ** 2).sum(axis=3)
        along = ((parts[:, :, None, :] - self.centres[None]) * unit[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        row = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(passes):
            for m in range(len(self.centres)):
                rest = total - along[row, m, codes[:, m]]
                codes[:, m] = (across[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[row, m, codes[:, m]]
        return codes.astype(np.uint8)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        codes = self.encode(x)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors of packed codes."""
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, : len(self.centres)]
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(packed), -1)[:, : self.dim]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): the inner product of each query with each pair of centres."""
        dots = np.einsum("qmd,mcd->mcq", self.cut(q), self.centres)
        if len(dots) % 2:
            dots = np.concatenate([dots, np.zeros_like(dots[:1])])
        return (dots[::2, None, :, :] + dots[1::2, :, None, :]).reshape(len(dots) // 2, 256, len(q)).astype(np.float32)


def fit(x: np.ndarray, threshold: float = THRESHOLD) -> Quantiser:
    """Centres from the rows of x: nearest-centre rounds first, then rounds under the anisotropic loss."""
    x = x.astype(np.float64)
    n, dim = x.shape
    codes_n = -(-dim // PER_CODE)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(0)
    model = Quantiser(dim, np.zeros((codes_n, CENTRES, PER_CODE)), 1.0)
    parts = model.cut(x)
    model.centres = parts[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2).copy()
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for k in range(ROUNDS):
        model.eta = 1.0 if k < ROUNDS // 2 else eta
        codes = model.encode(x, passes=1)
        row = np.arange(n)
        left = parts - model.centres[np.arange(codes_n)[None, :], codes]
        along = (left * unit).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(codes_n):
            u, p, w = unit[:, m], parts[:, m], model.eta - 1
            rest = total - along[row, m]
            normal = np.eye(PER_CODE)[None] + w * u[:, :, None] * u[:, None, :]
            goal = p + w * u * (rest + (p * u).sum(axis=1))[:, None]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    model.centres[m, c] = np.linalg.lstsq(normal[own].sum(axis=0), goal[own].sum(axis=0), rcond=None)[0]
    model.eta = eta
    return model


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and x, a double array: rows with an id and a vector of the most frequent length, finite and not zero."""
    x = F.col("embedding").cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select("vec_id", x.alias("x"))
    size = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("x") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def coded_blocks(distinct: DataFrame, model: Quantiser, buckets: int) -> DataFrame:
    """bucket, ids, codes, fine, numbers: blocks of up to ROW_BLOCK coded rows.

    numbers are, for each row, its squared length, the distance to its code, the unit of its fine codes, the distance left then,
    and its length.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids, x = part.column("gid").to_numpy(), _matrix(part.column("x"))
                codes = shared.value.pack(x)
                rest = x - shared.value.decode(codes)
                unit = np.maximum(np.abs(rest).max(axis=1) / FINE, 1e-300)
                fine = np.rint(rest / unit[:, None]).astype("<i2")
                length, far = np.linalg.norm(x, axis=1), np.linalg.norm(rest, axis=1)
                numbers = np.stack([length**2, far, unit, np.linalg.norm(rest - fine * unit[:, None], axis=1), length])
                blobs = ids.tobytes(), codes.tobytes(), fine.tobytes(), numbers.astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % buckets], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["bucket", "ids", "codes", "fine", "numbers"])

    return distinct.select("gid", "x").mapInArrow(run, "bucket int, ids binary, codes binary, fine binary, numbers binary")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """block, qids, q: the queries in blocks by hash."""
    rows = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x")
    return rows.groupBy("block").agg(F.collect_list(F.struct("vec_id", "x")).alias("rows")).select("block", F.transform("rows", lambda r: r["vec_id"]).alias("qids"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("q"))


def scan(pairs: DataFrame, model: Quantiser, need: int, candidates: int) -> DataFrame:
    """query_id, gid, low, high: the rows of each bucket that can be among the need nearest of a query, and between what their distance is.

    A block of queries meets the blocks of a bucket one after another, as it is the left side of a merge join; the need smallest
    upper bounds of each query are kept, so that what is shuffled grows with queries times buckets. In another order there would
    be more candidates, and none lost.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def out(qids: np.ndarray, top: np.ndarray, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            q, gid, low, high = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = low <= top[q]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (qids[q], gid, low, high)], names=["query_id", "gid", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                now = batch.column("block")[r].as_py(), batch.column("bucket")[r].as_py()
                if now != key:
                    if key is not None:
                        yield from out(qids, top, held)
                    if key is None or now[0] != key[0]:
                        qids = np.array(batch.column("qids")[r].as_py(), dtype=np.int64)
                        q = batch.column("q")[r].values.to_numpy(zero_copy_only=False).reshape(len(qids), -1)
                        tables, squares = shared.value.tables(q), (q * q).sum(axis=1)
                        lengths = np.sqrt(squares)
                    key, high, held, size = now, np.full((need, len(qids)), np.inf), [], 0
                ids = np.frombuffer(batch.column("ids")[r].as_py(), dtype="<i8")
                codes = np.frombuffer(batch.column("codes")[r].as_py(), dtype=np.uint8).reshape(len(ids), -1)
                square, far, unit, left, length = np.frombuffer(batch.column("numbers")[r].as_py(), dtype="<f8").reshape(5, -1)
                dots = np.zeros((len(ids), len(qids)), dtype=np.float32)
                for k in range(codes.shape[1]):
                    dots += tables[k][codes[:, k]]
                coarse = shared.value.decode(codes)
                x = coarse + np.frombuffer(batch.column("fine")[r].as_py(), dtype="<i2").reshape(coarse.shape) * unit[:, None]
                take = min(max(candidates, need), len(ids))
                best = np.argpartition(square[:, None] - 2 * dots, take - 1, axis=0)[:take]
                bound = np.sqrt(((x[best] - q) ** 2).sum(axis=2)) + left[best] + ROUNDING * (lengths + length[best])
                high = np.partition(np.concatenate([high, bound]), need - 1, axis=0)[:need]
                top = high.max(axis=0)
                spread = np.sqrt(np.maximum(squares + (coarse * coarse).sum(axis=1)[:, None] - 2 * dots, 0))
                some = np.flatnonzero((spread - COARSE_ROUNDING * (lengths + length[:, None]) - far[:, None] <= top).any(axis=1))
                y = x[some]
                near = np.sqrt(np.maximum(squares + (y * y).sum(axis=1)[:, None] - 2 * (y @ q.T), 0))
                slack = left[some, None] + ROUNDING * (lengths + length[some, None])
                row, at = np.nonzero(near - slack <= top)
                held.append((at, ids[some[row]], (near - slack)[row, at], (near + slack)[row, at]))
                size += len(row)
                if size > HELD:
                    yield from out(qids, top, held)
                    held, size = [], 0
        if key is not None:
            yield from out(qids, top, held)

    return pairs.select("block", "bucket", "qids", "q", "ids", "codes", "fine", "numbers").mapInArrow(run, "query_id bigint, gid bigint, low double, high double")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, by Euclidean distance, ties to the smaller vec_id.

    None is missed, as every row that the codes do not place beyond the nearest is ranked by its distance (see scan).

    Rows that are null, zero or not finite, that have no id, or whose length is not the most frequent one take no part. A
    query never finds rows of its own vec_id. A vec_id that is repeated is a candidate with each of its vectors, and a query
    with the one that sorts first. With fewer rows than k, all are found; an empty table gives no rows. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = cut(clean(vectors))
    ranked = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = cut(ranked.groupBy("x").agg(F.min("vec_id").alias("low"), F.sort_array(F.collect_list("vec_id")).alias("vec_ids")).withColumn("gid", F.xxhash64("x")))
    queries = cut(rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"), F.count_distinct("x").alias("own")))
    need = k + (queries.agg(F.max("own")).first()[0] or 0)
    sample = distinct.orderBy("gid").limit(FIT_ROWS).select("x").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    model = fit(np.stack(sample["x"].to_numpy()))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    buckets = partitions(spark)
    coded = coded_blocks(distinct.repartition(buckets), model, buckets)
    asked = query_blocks(queries, blocks).select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    guesses = cut(scan(asked.join(coded.hint("merge"), "bucket"), model, need, candidates))
    first = guesses.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("high"))).where(F.col("n") <= need)
    bounds = first.groupBy("query_id").agg(F.max("high").alias("top"))
    best = guesses.join(bounds, "query_id").where("low <= top").select("query_id", "gid")
    exact = (
        best.join(distinct.select("gid", "x", "vec_ids"), "gid")
        .join(queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")
        .select("query_id", distance(F.col("q"), F.col("x")).alias("score"), F.explode("vec_ids").alias("vec_id"))
        .where("vec_id <> query_id")
    )
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
