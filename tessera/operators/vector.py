"""Exact nearest neighbours, filtered and batched.

A filter is applied before the top k, so filtered rows never appear and never cost a place. Ties go to the
smaller id. Batched search takes its queries in blocks of about MAX_QUERIES, each a broadcast matrix; a task multiplies
its batches of vectors with it, keeps each query's k best so far with their distances computed once more directly, and
the few kept by all tasks are ranked by a bounded window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, distance, vector_literal
from ..predicate import Filter, restrict
from ..sources.steps import ship

MAX_QUERIES, QUERY_FLOATS, TILE = 10_000, 8_000_000, 1 << 21


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: Metric = Metric.COSINE, filters: Sequence[Filter] = (), rows: DataFrame | None = None, key: str = "_id", vec: str = "vec") -> DataFrame:
    """(key, distance) of the k nearest. filters are over `rows` (joined by key) or, without it, over vectors."""
    if filters:
        pool = restrict(rows, filters) if rows is not None else None
        vectors = vectors.join(pool.select(key), key, "left_semi") if pool is not None else restrict(vectors, filters)
    near = vectors.select(key, distance(metric, F.col(vec), vector_literal(query)).alias("distance"))
    return near.orderBy("distance", key).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: Metric = Metric.COSINE, key: str = "_id", vec: str = "vec", query_key: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(query_key, key, distance, rank) of the k nearest of each query; keys are integers; rows of one query id share a ranking.

    Vectors and queries that are null or of another length than the queries' commonest aren't compared.
    """
    queries = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
    vectors = vectors.select(F.col(key).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
    lengths = queries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.select(F.lit(0).cast("long").alias(query_key), F.col("i").alias(key), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    d, n = lengths
    blocks = -(-n // max(1, min(MAX_QUERIES, QUERY_FLOATS // max(d, 1))))
    at = F.pmod(F.xxhash64("q"), F.lit(blocks))
    vectors, queries = vectors.where(F.size("v") == d), queries.where(F.size("v") == d)
    near = reduce(DataFrame.unionByName, [_nearest(vectors, queries.where(at == b) if blocks > 1 else queries, k, metric) for b in range(blocks)])
    w = Window.partitionBy("q").orderBy("distance", "i")  # at most k rows of each task
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.select(F.col("q").alias(query_key), F.col("i").alias(key), "distance", "rank")


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), d)


def _exact(metric: Metric, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x and y, pair by pair."""
    if metric is Metric.EUCLIDEAN:
        return ((x - y) ** 2).sum(1)
    dot = (x * y).sum(1)
    if metric is Metric.DOT:
        return -dot
    size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    return np.where(size == 0, 1.0, 1 - dot / np.where(size == 0, 1, size))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """Each task's k nearest of each query."""
    ship(vectors.sparkSession)
    block = queries.toArrow()  # bounded by MAX_QUERIES and QUERY_FLOATS
    shared = vectors.sparkSession.sparkContext.broadcast((block.column("q").to_numpy(), pa.chunked_array(block.column("v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, column = shared.value
        q = _matrix(column, len(column[0]) if len(column) else 0)
        norm = (q * q).sum(1)
        best_i, best_d = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            step = max(1, TILE // max(len(q), 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x, i = _matrix(part.column("v"), q.shape[1]), part.column("i").to_numpy()
                rough = -(q @ x.T)
                if metric is Metric.EUCLIDEAN:
                    rough = norm[:, None] + (x * x).sum(1)[None, :] + 2 * rough
                elif metric is Metric.COSINE:
                    size = np.sqrt(norm)[:, None] * np.sqrt((x * x).sum(1))[None, :]
                    rough = np.where(size == 0, 1.0, 1 + rough / np.where(size == 0, 1, size))
                # All that may be among the k best, rounding aside; then their distances as such.
                if len(i) > k:
                    slack = 1e-9 * (1 + np.abs(rough).max(1, keepdims=True))
                    row, col = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack)
                else:
                    row, col = np.divmod(np.arange(len(q) * len(i)), max(len(i), 1))
                far = _exact(metric, x[col], q[row])
                old_row = np.repeat(np.arange(len(q)), best_i.shape[1])
                row, every_i, every_d = np.concatenate([old_row, row]), np.concatenate([best_i.ravel(), i[col]]), np.concatenate([best_d.ravel(), far])
                order = np.lexsort((every_i, every_d, row))
                row = row[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                order = order[place < k]
                best_i, best_d = every_i[order].reshape(len(q), -1), every_d[order].reshape(len(q), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_i.shape[1])), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["q", "i", "distance"])

    return vectors.mapInArrow(run, "q long, i long, distance double")
