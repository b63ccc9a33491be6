"""Approximate search by graphs: recall against brute force, filters, and graphs kept by collections."""

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest

from tessera import ColumnDef, DataType, Filter, open_database
from tessera.functions.distance import Metric
from tessera.operators import ann
from tessera.operators.vector import search_many
from tessera.types import SchemaError


def recall(spark, n: int, d: int, metric: Metric, shard: int, ef: int, ef_construction: int) -> float:
    x = np.random.default_rng(n).normal(size=(n, d)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, vec array<float>").repartition(4).cache()
    queries = df.where(f"_id % {n // 50} = 0").selectExpr("_id AS query_id", "transform(vec, c -> c + 0.1) AS query_vec")
    graphs = ann.build(df, d, metric, ef_construction=ef_construction, shard=shard).cache()
    assert graphs.count() == -(-n // shard)
    found = {(r["query_id"], r["_id"]) for r in ann.search_many(graphs, queries, d, 10, ef, metric).collect()}
    want = {(r["query_id"], r["_id"]) for r in search_many(df, queries, 10, metric).collect()}
    assert len(found) == len(want) == 500
    df.unpersist()
    graphs.unpersist()
    return len(found & want) / len(want)


@pytest.mark.parametrize("metric", list(Metric))
def test_recall_of_one_graph(spark, metric):
    assert recall(spark, 1000, 32, metric, 1000, 100, 100) >= 0.9


def test_recall_over_shards(spark):
    assert recall(spark, 6000, 64, Metric.EUCLIDEAN, 1500, 50, 60) >= 0.85


def test_odd_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(50, None), (51, [1.0]), (52, [float("nan"), 1.0]), (53, [0.0, 0.0]), (54, [None, 1.0])]
    df = spark.createDataFrame(rows, "_id long, vec array<float>")
    for metric in Metric:
        graphs = ann.build(df, 2, metric, shard=7)
        near = [tuple(r) for r in ann.search(graphs, [1.0, 2.0], 5, 80, metric).collect()]
        assert [i for i, _ in near] == [0, 1, 2, 3, 4] and len({d for _, d in near}) == 1
        allowed = df.where("_id IN (30, 53, 999)").select("_id")
        assert [r[0] for r in ann.search(graphs, [1.0, 2.0], 5, 10, metric, allowed=allowed).collect()] == [30, 53]
    none = ann.build(df.limit(0), 2)
    assert none.count() == 0 and ann.search(none, [1.0, 2.0]).count() == 0
    queries = df.where("_id > 38").selectExpr("_id AS query_id", "vec AS query_vec")
    assert {r["query_id"] for r in ann.search_many(graphs, queries.where("query_id NOT IN (52, 54)"), 2, 3).collect()} == {39, 53}
    assert ann.search_many(graphs, queries.limit(0), 2, 3).count() == 0


def test_collections_keep_graphs(spark, tmp_path):
    db = open_database(spark, f"file://{tmp_path}/db")
    db.create_table("t", [ColumnDef("a", DataType.INTEGER)])
    db.insert_many("t", [{"a": i % 3} for i in range(130)])
    db.create_collection("t", "v", 8, Metric.EUCLIDEAN, m=8, ef_construction=60)
    x = np.random.default_rng(1).normal(size=(130, 8))
    db.insert_vectors("t", "v", {i + 1: x[i].tolist() for i in range(120)})
    q = x[5].tolist()
    exact = lambda **o: [r["_id"] for r in db.vector_search("t", "v", q, 10, **o).collect()]
    assert exact(ef_search=20) == exact()  # no graph yet
    db.create_vector_graph("t", "v", shard=50)
    graph = db.snapshot().manifest["collections"][0]["graph"]
    assert exact(ef_search=60) == exact() and exact(ef_search=60, where=Filter.eq("a", 1)) == exact(where=Filter.eq("a", 1))
    db.insert_vectors("t", "v", {i + 1: x[i].tolist() for i in range(120, 129)} | {130: q})
    assert 130 in exact(ef_search=60) and exact(ef_search=60) == exact()
    db.vacuum()
    assert exact(ef_search=60) == exact() and db.snapshot().manifest["collections"][0]["graph"] == graph
    db.delete_vector("t", "v", 6)
    assert db.snapshot().manifest["collections"][0]["graph"] is None and 6 not in exact(ef_search=60)
    db.create_vector_graph("t", "v")
    db.drop_vector_graph("t", "v")
    assert exact(ef_search=60) == exact()
    db.create_table("s", [ColumnDef("a", DataType.INTEGER)], bytes(32))
    db.create_collection("s", "v", 2)
    with pytest.raises(SchemaError):
        db.create_vector_graph("s", "v")


def test_registered_query_recall(spark, sf):
    from tessera.plans.queries import QUERIES

    found = QUERIES["knn_graph"](spark, sf).select("query_id", "vec_id")
    exact = QUERIES["knn_batch"](spark, sf).select("query_id", "vec_id")
    assert found.count() == exact.count()
    assert found.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()


def test_workers_find_the_library_from_any_folder(tmp_path, sf):
    """Workers of a session that began elsewhere import the functions sent to them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nfrom tessera.plans.queries import QUERIES\n"
    code += "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
    code += f"print([QUERIES[n](s, {sf!r}).count() for n in ('knn_batch', 'knn_graph')])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    few, more = eval(got.stdout.strip().splitlines()[-1])
    assert few == more > 0
