"""Embedding near-dedup by product quantisation over coarse inverted lists.

Vectors are scaled to length 1. Coarse centroids (one for LIST_SIZE vectors, each fitted on SAMPLES_A_LIST sampled
vectors at least) and residual codebooks (SUBSPACES parts of up to 256 codes) are fitted on a hashed sample of about
SAMPLE vectors; every vector is indexed in its nearest list. A vector visits every list that can hold a link: those
whose centre is within the link radius plus the list's radius, and whose border with its own list is within the
link radius. Of two lists the later one's vectors visit the earlier one, and a link between them counts at both ends;
within a list each vector counts its own links. No list that holds a link is left out, so the links are those of brute force; on vectors without any
structure the bounds leave out little, and the work grows with the square of the table.

In a list the asymmetric distance to each coded member is taken from its decoded vector; as the length of a member's
coding error is stored with it, members farther than the link radius plus that length can't be links and are left out
without loss. The rest is reranked by cosine in double precision from the vectors themselves.

Equal vectors become one row with a count first. Near lists form cells of about MEMBERS vectors, and a vector is sent
once to each cell that it visits; a cell's members and visitors are cut into blocks of bounded size, so that a hot
list spreads over many tasks. Tasks give counts and a spanning forest of the links
they find, never all pairs.

Vectors of different lengths have no cosine; each length has its own index. Vectors that are null, empty, zero, or hold
null or non-finite components link with nothing. Repeated ids keep their rows and share their links; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from ._components import components
from ._session import ship, table, written

LEAST, LIST_SIZE, MAX_LISTS, SAMPLE, SUBSPACES = 0.9, 64, 16384, 16384, 8
SAMPLES_A_LIST = 8
MEMBERS, VISITORS, TILE = 8192, 8192, 512


@dataclass
class Index:
    coarse: np.ndarray  # lists x dimension; the lists of a cell stand together
    cell: np.ndarray  # the cell of each list
    codes: np.ndarray  # subspaces x codes x part of the (padded) dimension


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[a : a + 1024] @ centres.T - half).argmax(1) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows; an empty centre keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return centres


def _parts(x: np.ndarray, subspaces: int = SUBSPACES) -> np.ndarray:
    """x padded and cut: rows x subspaces x width."""
    width = -(-x.shape[1] // subspaces)
    out = np.zeros((len(x), subspaces * width), x.dtype)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), subspaces, width)


def fit(sample: np.ndarray, lists: int, cells: int = 1) -> Index:
    sample = sample.astype(np.float32)
    coarse = kmeans(sample, max(1, min(lists, len(sample) // SAMPLES_A_LIST)))
    cell = _nearest(coarse, kmeans(coarse, min(cells, len(coarse))))
    order = np.argsort(cell, kind="stable")
    coarse, cell = coarse[order], cell[order]
    rest = _parts(sample - coarse[_nearest(sample, coarse)])
    return Index(coarse, cell, np.stack([kmeans(rest[:, m], min(256, len(sample))) for m in range(rest.shape[1])]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(z: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel().astype(np.int32)))


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        coarse = index.coarse.astype(np.float64)
        half = (coarse**2).sum(1) / 2
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _unit(_matrix(part.column("vec")))
                own = (half - x @ coarse.T).argmin(1)
                far = np.sqrt(((x - coarse[own]) ** 2).sum(1))
                rest = _parts(x.astype(np.float32) - index.coarse[own])
                codes = np.stack([_nearest(rest[:, m], index.codes[m]) for m in range(rest.shape[1])], axis=1)
                back = index.codes[np.arange(rest.shape[1])[None, :], codes]
                error = np.sqrt(((rest - back) ** 2).sum((1, 2)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("vec"), pa.array(own.astype(np.int32)), _lists(codes), pa.array(error), pa.array(far)], names=["rep", "copies", "vec", "list", "codes", "error", "far"])

    return run


def _visited(index: Index, radii: np.ndarray, x: np.ndarray, own: np.ndarray, radius: float, first: int = 0, last: int | None = None) -> np.ndarray:
    """rows x lists first to last: whether the list can hold a vector within the radius of the row.

    A list's vectors are no farther from its centre than its radius, and no nearer to another centre; the latter
    bounds how far a row of list `own` is at least from all of them. Empty lists have a negative radius.
    """
    coarse = index.coarse.astype(np.float64)
    some, norm = coarse[first:last], (coarse**2).sum(1)
    apart = 1 + norm[first:last] - 2 * x @ some.T
    mine = 1 + norm[own] - 2 * (x * coarse[own]).sum(1)
    gap = norm[first:last] + norm[own][:, None] - 2 * coarse[own] @ some.T
    can = apart <= (radius + radii[first:last] + 1e-5) ** 2
    can &= apart - mine[:, None] <= 2 * radius * np.sqrt(np.maximum(gap, 0)) + 1e-5
    return can & (radii[first:last] >= 0)


def _cells(shared, shared_radii, least: float):
    """Each row's cells to visit."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, radii = shared.value, shared_radii.value
        starts = np.flatnonzero(np.diff(index.cell, prepend=-1))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own = part.column("list").to_numpy()
                can = _visited(index, radii, _unit(_matrix(part.column("vec"))), own, radius)
                can &= np.arange(len(radii))[None, :] <= own[:, None]
                row, cell = np.nonzero(np.logical_or.reduceat(can, starts, axis=1))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(index.cell[starts][cell].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "copies", "vec", "list")), pa.array(index.cell[own].astype(np.int32)), cells, part.column("codes"), part.column("error")], names=["rep", "copies", "vec", "list", "cell", "cells", "codes", "error"])

    return run


def _labels(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a link matrix; unlinked ones have their own or none (-1)."""
    rows = np.arange(hit.shape[0])
    while True:
        cols = np.where(hit, rows[:, None], hit.shape[0]).min(0)
        new = np.minimum(rows, np.where(hit, cols[None, :], hit.shape[0]).min(1))
        if (new == rows).all():
            return rows, np.where(cols == hit.shape[0], -1, cols)
        rows = new


def _search(shared, shared_radii, least: float):
    """One block of members (side 1) and one of visitors (side 0) of a cell."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def run(block: pa.Table) -> pa.Table:
        index, radii = shared.value, shared_radii.value
        block = block.sort_by([("side", "ascending"), ("list", "ascending")])
        side = block.column("side").to_numpy()
        rep, copies, at = (block.column(c).to_numpy() for c in ("rep", "copies", "list"))
        members, visitors = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        out_u, out_v, out_n = [], [], []
        if len(members) and len(visitors):
            x = _unit(_matrix(block.column("vec").combine_chunks()))
            codes = _matrix(block.column("codes").combine_chunks().take(pa.array(members)))
            reach = radius + block.column("error").to_numpy()[members] + 1e-4
            held = at[members]
            decoded = index.codes[np.arange(codes.shape[1])[None, :], codes].reshape(len(members), -1)[:, : x.shape[1]] + index.coarse[held]
            own = (decoded**2).sum(1)
            first, last = int(held[0]), int(held[-1]) + 1
            for t in range(0, len(visitors), TILE):
                tile = visitors[t : t + TILE]
                can = _visited(index, radii, x[tile], at[tile], radius, first, last)
                can &= np.arange(first, last)[None, :] <= at[tile][:, None]
                cols = np.flatnonzero(can.any(0)[held - first])
                hit = np.zeros((len(tile), len(members)), bool)
                near = own[None, cols] - 2 * x[tile].astype(np.float32) @ decoded[cols].T <= (reach[cols] ** 2 - 1)[None, :]
                i, j = np.nonzero(near)
                j = cols[j]
                fresh = can[i, held[j] - first] & (rep[tile[i]] != rep[members[j]])
                i, j = i[fresh], j[fresh]
                for z in range(0, len(i), 65536):
                    p, r = i[z : z + 65536], j[z : z + 65536]
                    hit[p, r] = np.einsum("nd,nd->n", x[tile[p]], x[members[r]]) >= least
                rows = np.flatnonzero(hit.any(1))
                if len(rows):
                    hit, seen = hit[rows], tile[rows]
                    # Members of the visitor's own list visit it themselves; others don't.
                    back = copies[seen] @ (hit & (held[None, :] < at[seen][:, None]))
                    label, column = _labels(hit)
                    name = np.full(len(rows), np.iinfo(np.int64).max)
                    np.minimum.at(name, label, rep[tile[rows]])
                    linked = np.flatnonzero(column >= 0)
                    np.minimum.at(name, column[linked], rep[members[linked]])
                    out_u += [rep[tile[rows]], rep[members[linked]]]
                    out_v += [name[label], name[column[linked]]]
                    out_n += [hit @ copies[members], back[linked]]
        join = lambda z: pa.array(np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64))
        return pa.table({"u": join(out_u), "v": join(out_v), "n": join(out_n)})

    return run


def _kind(kind: DataType) -> str:
    """Vectors are carried as they are given, in floats where these hold them exactly; cosines are taken in doubles."""
    return "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"


def near_vectors(vectors: DataFrame, least: float = LEAST, list_size: int = LIST_SIZE, sample: int = SAMPLE, probes: int | None = None) -> DataFrame:
    """vectors: vec_id (an integer), embedding. One row (vec_id, n_links, component_id) for each row.

    probes is accepted and changes nothing: every list that can hold a link is visited.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = _kind(vectors.schema["embedding"].dataType)
    vec = F.col("embedding").cast(kind)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.select("vec_id", "vec", F.coalesce(finite, F.lit(False)).alias("good"), F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))
    good = rows.where("good")
    reps = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps, "vector-classes")
    every = written(good.select("k1", "k2", F.col("vec_id").alias("rep"), "vec").join(reps, ["k1", "k2", "rep"]).dropDuplicates(["k1", "k2"]).select("rep", "copies", "vec"), "vectors")
    lengths = {r[0]: r[1] for r in every.groupBy(F.size("vec")).count().collect()}  # as many rows as there are lengths
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = reduce(DataFrame.unionByName, [_links(every if len(lengths) == 1 else every.where(F.size("vec") == d), n, least, list_size, sample) for d, n in sorted(lengths.items())])
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    part = components(found.select("u", "v"))
    about = reps.join(links, "rep", "left").join(part.select(F.col("u").alias("rep"), F.col("v").alias("low")), "rep", "left")
    about = written(about.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id")), "vector-results")
    told = rows.join(about, ["k1", "k2"], "left")
    return told.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


def _links(one: DataFrame, n: int, least: float, list_size: int, sample: int) -> DataFrame:
    """one: n distinct vectors (rep, copies, vec) of one length. Rows (u, v, n): a spanning forest of links and counts of them."""
    spark = one.sparkSession
    drawn = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < F.lit(min(1.0, sample / n) * (1 << 20))
    some = [r[0] for r in one.where(drawn).orderBy(F.xxhash64("rep"), "rep").select("vec").limit(2 * sample).collect()] or [one.first()["vec"]]
    index = fit(_unit(np.array(some)), min(MAX_LISTS, -(-n // list_size)), -(-n // MEMBERS))
    shared = spark.sparkContext.broadcast(index)
    vec = _kind(one.schema["vec"].dataType)
    kinds = f"rep long, copies long, vec {vec}, list int, codes array<int>, error float, far double"
    coded = written(one.mapInArrow(_index(shared), kinds), "coded")
    radii = np.full(len(index.coarse), -1.0)
    for at, far in coded.groupBy("list").agg(F.max("far")).collect():  # at most MAX_LISTS rows of two numbers
        radii[at] = far
    bounds = spark.sparkContext.broadcast(radii)
    kinds = f"rep long, copies long, vec {vec}, list int, cell int, cells array<int>, codes array<int>, error float"
    coded = written(coded.mapInArrow(_cells(shared, bounds, least), kinds), "visits")
    held = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("mb"))
    seen = coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("qb"))
    blocks = written(held.join(seen, "cell"), "cells")  # at most MAX_LISTS rows of three numbers
    salt = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = coded.drop("cells").join(F.broadcast(blocks), "cell").select("cell", salt("mb").alias("m"), span("qb").alias("q"), F.lit(1).alias("side"), "rep", "copies", "vec", "list", "codes", "error")
    visitors = coded.select("rep", "copies", "vec", "list", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell")
    visitors = visitors.select("cell", span("mb").alias("m"), salt("qb").alias("q"), F.lit(0).alias("side"), "rep", "copies", "vec", "list", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("float").alias("error"))
    return written(members.unionByName(visitors).groupBy("cell", "m", "q").applyInArrow(_search(shared, bounds, least), "u long, v long, n long"), "vector-links")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS c FROM v UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
