"""Batched search over more queries than one broadcast block."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions.distance import Metric
from tessera.operators import vector


def test_batched_search_takes_any_number_of_queries(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), float(i)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "_id long, vec array<double>")
    queries = spark.createDataFrame([*rows[:40], (3, [9.0, 9.0, 9.0])], "query_id long, query_vec array<double>")
    run = lambda: sorted(tuple(r) for r in vector.search_many(vectors, queries, 3, Metric.EUCLIDEAN).collect())
    whole = run()
    assert len(whole) == 40 * 3
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    assert run() == whole


@pytest.mark.parametrize("metric", list(Metric))
def test_batched_search_against_brute_force(spark, monkeypatch, metric):
    """Blocks of queries, tiles of vectors, ties, nulls and zero vectors; 1,000 x 32."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1000, 32)).round(3)
    x[7], x[500:520], x[3] = x[8], x[0], 0
    monkeypatch.setattr(vector, "MAX_QUERIES", 9)
    monkeypatch.setattr(vector, "TILE", 700)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0])]
    df = spark.createDataFrame(rows, "_id long, vec array<double>").repartition(3)
    queries = df.where("_id % 50 = 0").selectExpr("_id AS query_id", "vec AS query_vec")
    got = {(r["query_id"], r["rank"]): (r["_id"], round(r["distance"], 9)) for r in vector.search_many(df, queries, 10, metric).collect()}
    want = {}
    for q in range(0, 1000, 50):
        if metric is Metric.EUCLIDEAN:
            d = ((x - x[q]) ** 2).sum(1)
        elif metric is Metric.DOT:
            d = -(x * x[q]).sum(1)
        else:
            size = np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum())
            d = np.where(size == 0, 1.0, 1 - (x * x[q]).sum(1) / np.where(size == 0, 1, size))
        for k, i in enumerate(np.lexsort((np.arange(1000), d))[:10], 1):
            want[q, k] = (int(i), round(float(d[i]), 9))
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert sum(got[k][0] == want[k][0] for k in want) >= len(want) - 20  # copies tie but for rounding
    assert vector.search_many(df.limit(0), queries, 3).count() == 0 and vector.search_many(df, queries.limit(0), 3).count() == 0
