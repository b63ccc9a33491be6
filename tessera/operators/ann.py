"""Approximate nearest neighbours: one navigable small-world graph for each shard of the vectors.

The graphs are those of Malkov and Yashunin (2018, algorithms 1 to 5). Vectors are dealt to shards of about SHARD rows by
a hash of their id, so that a graph fits a task whatever the table's size; tasks build them, and a graph is one row of
arrays that is written and kept like any unit. A search is sent to all shards: each descends greedily through its upper
layers, keeps `ef` candidates on the lowest one, and gives its k nearest; k rows a shard are ranked at the end. More
shards only raise recall, as each gives k.

Filtered-out rows are walked through but never given. Distances are recomputed in double precision from the vectors
given, by the same formulas as exact search; ties go to the smaller id. Vectors that are null, hold null or non-finite
components, or have another length than `dimensions` aren't indexed. The layers of a row follow from its id, so equal tables give equal graphs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric
from ..sources.steps import ship
from .vector import MAX_QUERIES, QUERY_FLOATS, _exact, _matrix

SHARD, M, EF_CONSTRUCTION = 10_000, 16, 200
#: One row a shard: ids, vectors, the layer of each row, and for each layer its rows, offsets and neighbours on end.
GRAPH = "shard int, ids array<long>, vecs array<float>, tops array<int>, links array<struct<rows: array<int>, ends: array<int>, to: array<int>>>"


class Graph:
    """A graph under construction or read back; `links[layer][row]` are a row's neighbours there."""

    def __init__(self, x: np.ndarray, metric: Metric, m: int, tops: np.ndarray, links: list[dict[int, np.ndarray]] | None = None):
        self.x, self.metric, self.m, self.tops = x, metric, m, tops
        if metric is Metric.COSINE:  # scaled rows leave one product a distance
            size = np.sqrt((x * x).sum(1, keepdims=True))
            self.x = x / np.where(size == 0, 1, size)
        self.links = links if links is not None else [{} for _ in range(int(tops.max(initial=0)) + 1)]
        self.entry = int(tops.argmax()) if len(tops) else -1

    def far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        some = self.x[rows]
        if self.metric is Metric.EUCLIDEAN:
            some = some - q
            return np.einsum("nd,nd->n", some, some)
        return -(some @ q)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        size = math.sqrt(float(q @ q))
        return q / size if self.metric is Metric.COSINE and size else q

    def greedy(self, q: np.ndarray, at: int, layer: int) -> int:
        """The row from which no neighbour of the layer is nearer."""
        best = float(self.far(q, np.array([at]))[0])
        while len(near := self.links[layer][at]):
            d = self.far(q, near)
            k = int(d.argmin())
            if d[k] >= best:
                break
            best, at = float(d[k]), int(near[k])
        return at

    def beam(self, q: np.ndarray, at: int, layer: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Up to ef nearest (distance, row) found from a row; rows that aren't allowed are walked, not kept."""
        seen = np.zeros(len(self.x), bool)
        seen[at] = True
        d = float(self.far(q, np.array([at]))[0])
        todo = [(d, at)]
        kept = [(-d, at)] if allowed is None or allowed[at] else []
        links = self.links[layer]
        while todo:
            d, row = heapq.heappop(todo)
            if len(kept) == ef and d > -kept[0][0]:
                break
            near = links[row]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for d, row in zip(self.far(q, near).tolist(), near.tolist()):
                if len(kept) < ef or d < -kept[0][0]:
                    heapq.heappush(todo, (d, row))
                    if allowed is None or allowed[row]:
                        (heapq.heappush if len(kept) < ef else heapq.heappushpop)(kept, (-d, row))
        return sorted((-d, row) for d, row in kept)

    def diverse(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Those nearer to the new row than to every one chosen before; the nearest others fill up."""
        rows = np.array([r for _, r in found])
        if len(rows) <= most:
            return rows
        some = self.x[rows]
        apart = -(some @ some.T)
        if self.metric is Metric.EUCLIDEAN:
            norm = (some * some).sum(1)
            apart = norm[:, None] + norm[None, :] + 2 * apart
        chosen, left, least = [], [], np.full(len(rows), np.inf)
        for i, (d, _) in enumerate(found):
            if d < least[i]:
                chosen.append(i)
                np.minimum(least, apart[i], out=least)
                if len(chosen) == most:
                    break
            else:
                left.append(i)
        return rows[chosen + left[: most - len(chosen)]]

    def connect(self, row: int, layer: int, found: list[tuple[float, int]]) -> None:
        links, most = self.links[layer], 2 * self.m if layer == 0 else self.m
        links[row] = self.diverse(found, self.m)
        for other in links[row].tolist():
            near = np.append(links[other], row)
            if len(near) > most:
                d = self.far(self.x[other], near)
                order = np.argsort(d, kind="stable")
                near = self.diverse(list(zip(d[order].tolist(), near[order].tolist())), most)
            links[other] = near

    def build(self, ef: int) -> Graph:
        """Rows enter from the topmost layer's first one on, then in their order."""
        if not len(self.x):
            return self
        entry, none = self.entry, np.zeros(0, np.int64)
        for layer in range(len(self.links)):
            self.links[layer][entry] = none
        for row in range(len(self.x)):
            if row == entry:
                continue
            q, at, top = self.x[row], entry, int(self.tops[row])
            for layer in range(len(self.links) - 1, top, -1):
                at = self.greedy(q, at, layer)
            for layer in range(top, -1, -1):
                found = self.beam(q, at, layer, ef)
                at = found[0][1]
                self.connect(row, layer, found)
        return self

    def search(self, q: np.ndarray, ef: int, allowed: np.ndarray | None = None) -> np.ndarray:
        if self.entry < 0:
            return np.zeros(0, np.int64)
        q, at = self.scaled(q), self.entry
        for layer in range(len(self.links) - 1, 0, -1):
            at = self.greedy(q, at, layer)
        return np.array([r for _, r in self.beam(q, at, 0, ef, allowed)], np.int64)


def layers(ids: np.ndarray, m: int) -> np.ndarray:
    """The top layer of each row: -ln(u) / ln(m) for a u in (0, 1] mixed from its id."""
    mixed = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    u = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1
    return np.floor(-np.log(u / 2.0**53) / math.log(max(m, 2))).astype(np.int32)


def build(vectors: DataFrame, dimensions: int, metric: Metric = Metric.COSINE, m: int = M, ef_construction: int = EF_CONSTRUCTION, key: str = "_id", vec: str = "vec", shard: int = SHARD) -> DataFrame:
    """Rows of GRAPH. Counts the vectors once to set the number of shards."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where((F.size("v") == dimensions) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    ship(vectors.sparkSession)
    shards = max(1, -(-rows.count() // shard))
    kind = metric.value

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable")
        ids, x = block["id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float32)
        graph = Graph(x, Metric(kind), m, layers(ids, m)).build(max(ef_construction, m))
        links = []
        for layer in graph.links:
            at = sorted(layer)
            links.append({"rows": at, "ends": np.cumsum([len(layer[r]) for r in at]).tolist(), "to": np.concatenate([layer[r] for r in at]).astype(int).tolist()})
        return pd.DataFrame({"shard": [int(block["shard"].iloc[0])], "ids": [ids], "vecs": [x.ravel()], "tops": [graph.tops], "links": [links]})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, GRAPH)


def _read(batch: pa.RecordBatch, i: int, metric: Metric, m: int) -> tuple[np.ndarray, np.ndarray, Graph]:
    flat = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
    ids, x, links = flat("ids"), flat("vecs"), []
    x = x.reshape(len(ids), -1)
    for layer in batch.column("links")[i].values.to_pylist():
        ends = layer["ends"]
        links.append(dict(zip(layer["rows"], np.split(np.array(layer["to"], np.int64), ends[:-1]))))
    return ids, x, Graph(x, metric, m, flat("tops"), links)


def _found(graphs: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, ef: int | None, metric: Metric, m: int) -> DataFrame:
    """(q, i, distance): each shard's k nearest of each query."""
    ship(graphs.sparkSession)
    shared, ef, kind = graphs.sparkSession.sparkContext.broadcast((ids, asked)), max(k, ef or 10), metric.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, graph = _read(batch, i, Metric(kind), m)
                may = np.isin(ids, batch.column("allowed")[i].values.to_numpy()) if "allowed" in batch.schema.names else None
                x = x.astype(np.float64)
                for name, q in zip(names, asked):
                    found = graph.search(q.astype(np.float32), ef, may)
                    far = _exact(Metric(kind), x[found], q[None, :])
                    best = np.lexsort((ids[found], far))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), name, np.int64)), pa.array(ids[found][best]), pa.array(far[best])], names=["q", "i", "distance"])

    return graphs.mapInArrow(run, "q long, i long, distance double")


def search(graphs: DataFrame, query: Sequence[float], k: int = 10, ef: int | None = None, metric: Metric = Metric.COSINE, m: int = M, allowed: DataFrame | None = None, key: str = "_id") -> DataFrame:
    """(key, distance) of about the k nearest. allowed: the rows (key) that may be given; if few, all of the graph is walked."""
    if allowed is not None:
        own = graphs.select("shard", F.explode("ids").alias("id")).join(allowed.select(F.col(key).cast("long").alias("id")), "id", "left_semi")
        graphs = graphs.join(own.groupBy("shard").agg(F.collect_set("id").alias("allowed")), "shard")  # at most a shard's ids
    found = _found(graphs, np.zeros(1, np.int64), np.array([[float(c) for c in query]]), k, ef, metric, m)
    return found.select(F.col("i").alias(key), "distance").orderBy("distance", key).limit(k)


def search_many(graphs: DataFrame, queries: DataFrame, dimensions: int, k: int = 10, ef: int | None = None, metric: Metric = Metric.COSINE, m: int = M, key: str = "_id", query_key: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(query_key, key, distance, rank) of about the k nearest of each query, by blocks of queries; ids of queries are distinct.

    Queries that are null or of another length than `dimensions` find nothing.
    """
    queries = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where(F.size("v") == dimensions)
    blocks = max(1, -(-queries.count() // max(1, min(MAX_QUERIES, QUERY_FLOATS // dimensions))))
    found = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        found.append(_found(graphs, block.column("q").to_numpy(), _matrix(block.column("v"), dimensions), k, ef, metric, m))
    near = reduce(DataFrame.unionByName, found)
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "i"))  # k rows a shard at most
    near = near.withColumn("rank", place).where(F.col("rank") <= k)
    return near.select(F.col("q").alias(query_key), F.col("i").alias(key), "distance", "rank")
