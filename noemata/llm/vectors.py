"""Nearest neighbours by largest inner product, from randomly rotated one-bit codes.

Vectors are centred on the mean of all of them, divided by their length and rotated at random; a code keeps the sign of
each component, packed in bits. With it go the length of the centred vector, the inner product of the unit vector with
its code (the correction scalar) and the inner product of the centre with the vector. The inner product of a query with
a vector is estimated from them, with an error bound of `sigmas` standard deviations that shrinks with the dimension. For
each query the k-th largest lower bound is a threshold; vectors whose upper bound reaches it are reranked by their
original values in double precision.

Queries go in blocks of `block` rows (that is what is broadcast, whatever the input), each against all rows; every task
keeps the best k of its rows for each query, and these few are merged.

Cases: vectors that are null or empty, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of different dimensions have no inner product and don't meet; ids that are null take no part; of rows
of the same id the least vector (compared as an array) counts; ties go to the smaller id; with fewer than k candidates all
are returned; an empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double), dimension of the rows that take part, one for each id."""
    array = F.col("embedding").cast("array<double>")
    fine = F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(array, lambda x: x != 0)
    picked = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), array.alias("embedding"))
    return picked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dimension", F.size("embedding"))


def encode(rows: DataFrame, dimension: int, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """rows with code (packed signs), length and correction; the embedding stays for the reranking."""

    def coded(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"), dimension) - centre
            length = np.linalg.norm(x, axis=1)
            unit = (x / np.where(length > 0, length, 1)[:, None]) @ turn.T
            bits = np.packbits(unit > 0, axis=1)
            correction = np.abs(unit).sum(1) / np.sqrt(dimension)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(correction)],
                names=["vec_id", "embedding", "code", "length", "correction"],
            )

    return rows.select("vec_id", "embedding").mapInArrow(coded, "vec_id long, embedding array<double>, code binary, length double, correction double")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


class Part:
    """The best k so far of one task's rows for each query of a block."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, sigmas: float):
        self.queries, self.ids, self.k, self.sigmas = queries, ids, k, sigmas
        self.turned = queries @ turn.T
        self.at_centre = queries @ centre
        self.norms = np.linalg.norm(queries, axis=1)
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        self.reranked = 0

    def add(self, vec_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, correction: np.ndarray) -> None:
        d = self.queries.shape[1]
        signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
        safe = np.where(correction > 0, correction, 1)
        spread = self.sigmas * length * np.sqrt(np.maximum(0, 1 - safe**2) / safe**2 / max(1, d - 1))
        # Products by a matrix routine may differ from sums in order by rounding alone: at most this, for a query of norm 1.
        rounding = 4 * d * np.finfo(float).eps * float(np.linalg.norm(vectors, axis=1).max(initial=0))
        for start in range(0, len(self.ids), 256):
            some = slice(start, start + 256)
            around = (self.turned[some].astype(np.float32) @ signs.T) / np.sqrt(d) * (length / safe)
            estimate = self.at_centre[some][:, None] + around
            error = self.norms[some][:, None] * spread
            lower, upper = estimate - error, estimate + error
            for i in range(lower.shape[0]):
                q = start + i
                had, scores = self.found[q]
                other = vec_ids != self.ids[q]
                low = np.concatenate([lower[i][other], scores])
                floor = np.partition(low, len(low) - self.k)[len(low) - self.k] if len(low) > self.k else -np.inf
                at = np.flatnonzero(other & (upper[i] >= floor))
                self.reranked += len(at)
                close = vectors[at] @ self.queries[q]
                every = np.concatenate([close, scores])
                margin = 2 * rounding * self.norms[q] + np.finfo(float).tiny
                if len(every) > self.k and np.isfinite(margin) and np.isfinite(close).all():  # sums in order only for what may be among the best by the products
                    at = at[close >= np.partition(every, len(every) - self.k)[len(every) - self.k] - margin]
                exact = np.add.accumulate(vectors[at] * self.queries[q], axis=1)[:, -1]  # summed from the first component on
                ids, all_scores = np.concatenate([had, vec_ids[at]]), np.concatenate([scores, exact])
                top = best_of(ids, all_scores, self.k)
                self.found[q] = ids[top], all_scores[top]


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int = 16384, sigmas: float = 4.0, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, its k nearest of all other rows."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    parts = []
    for (dimension,) in sorted(rows.select("dimension").distinct().collect()):
        same = rows.where(F.col("dimension") == dimension)
        centre = np.array(same.select(*[F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(dimension)]).first(), float)
        turn = rotation(dimension, seed)
        codes = written(encode(same, dimension, centre, turn), "codes")
        last = None
        while True:
            asked = codes.where(F.col("vec_id") % every == 0).where("true" if last is None else f"vec_id > {last}").orderBy("vec_id").limit(block).select("vec_id", "embedding").toArrow()
            if not asked.num_rows:
                break
            ids = np.asarray(asked.column("vec_id").combine_chunks())
            sent = spark.sparkContext.broadcast((ids, matrix(asked.column("embedding").combine_chunks(), dimension)))
            last = int(ids[-1])

            def scan(batches, sent=sent, dimension=dimension, centre=centre, turn=turn):
                query_ids, queries = sent.value
                part = Part(queries, query_ids, centre, turn, k, sigmas)
                for batch in batches:
                    if len(batch):
                        packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), -1)
                        part.add(np.asarray(batch.column("vec_id")), matrix(batch.column("embedding"), dimension), packed, np.asarray(batch.column("length")), np.asarray(batch.column("correction")))
                sizes = [len(x) for x, _ in part.found]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(query_ids, sizes), "vec_id": np.concatenate([x for x, _ in part.found]), "score": np.concatenate([s for _, s in part.found])})

            parts.append(codes.mapInArrow(scan, "query_id long, vec_id long, score double"))
            if asked.num_rows < block:
                break
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


#: The exact search in SQL: every query against every row.
SQL = """
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
