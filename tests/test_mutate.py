from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import mutate


def test_ids_are_consecutive_in_order(spark):
    df = spark.range(30_000).select((F.hash("id") % 5000).alias("k"), F.col("id").alias("v")).repartition(7)
    got = mutate.with_ids(df, 5, ["k", "v"]).orderBy("_id").collect()
    assert [r["_id"] for r in got] == list(range(5, 30_005))
    assert [(r["k"], r["v"]) for r in got] == sorted((r["k"], r["v"]) for r in got)
    assert mutate.with_ids(df.limit(0), 1, ["k"]).count() == 0
