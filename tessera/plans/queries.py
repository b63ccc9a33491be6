"""Registered queries: each applies one operator to a whole table; order is made visible as `pos`."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Database
from ..functions.counters import add_wrapping
from ..functions.distance import Metric
from ..operators import ann, joins, mutate, query, vector
from ..operators.query import FindOptions, ScanOrder, Sort
from ..predicate import Filter as P
from ..sources.steps import settled, shared_dir
from ..types import ColumnDef, DataType

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A bounded page with its place as a column."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _found(table: str, key: str, columns: Sequence[str], filters: Sequence[P] = (), or_groups: Sequence[Sequence[P]] = ()) -> Query:
    """A find without order or limits."""
    return lambda spark, sf: query.find(read(spark, sf, table), FindOptions(filters, or_groups, columns=columns, ordered=False), key).rows


def _page(table: str, key: str, columns: Sequence[str], sort: Sequence[Sort], limit: int, offset: int = 0, filters: Sequence[P] = ()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = read(spark, sf, table)
        rows = query.find(df, FindOptions(filters, (), sort, limit, offset), key).rows
        return placed(rows, query.order_of(df, sort, key)).select("pos", *columns)

    return run


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """documents with quality and toxic, null where a document has no label."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf, "labels"), "doc_id", "left")


def _labelled(filters: Sequence[P], or_groups: Sequence[Sequence[P]] = ()) -> Query:
    return lambda spark, sf: query.find(labelled(spark, sf), FindOptions(filters, or_groups, columns=["doc_id", "lang", "quality", "toxic"], ordered=False), "doc_id").rows


def _labelled_page(sort: Sequence[Sort], limit: int, behind: str | None = None) -> Query:
    """A page; with `behind`, one that begins `limit` / 2 rows before the first row with that column set (or the last without)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = labelled(spark, sf)
        offset = max(0, query.count(df, [P.is_null(behind)]) - limit // 2) if behind else 0
        rows = query.find(df, FindOptions(sort=sort, limit=limit, offset=offset), "doc_id").rows
        return placed(rows, query.order_of(df, sort, "doc_id")).select("pos", "doc_id", "quality")

    return run


def find_with_total(spark: SparkSession, sf: str) -> DataFrame:
    """Total and page in one scan: the total is a one-row aggregate joined to the page."""
    df = read(spark, sf, "orders")
    filters, sort = [P.gt("o_totalprice", 100000.0)], [Sort.desc("o_totalprice")]
    page = query.find(df, FindOptions(filters, sort=sort, limit=20, offset=10), "o_orderkey").rows
    total = query.count_frame(df, filters).withColumnRenamed("n", "total")
    return placed(page, query.order_of(df, sort, "o_orderkey")).join(F.broadcast(total)).select("pos", "o_orderkey", "total")


def _count(table: str, filters: Sequence[P] = (), or_groups: Sequence[Sequence[P]] = ()) -> Query:
    return lambda spark, sf: query.count_frame(read(spark, sf, table), filters, or_groups)


def _scan(order: ScanOrder, token: Sequence | None, limit: int, filters: Sequence[P] = ()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        page = query.scan_page(read(spark, sf, "orders"), order, token, limit - 1, filters, key="o_orderkey")
        by = [F.col(c).desc() if order.descending else F.col(c).asc() for c in (*order.columns, "o_orderkey")]
        return placed(page, by).select("pos", "o_orderkey", "o_custkey")

    return run


def scan_all_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of a descending index cursor, with its number: the pages tile the table."""
    df = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    total = df.count()
    size = max(1, -(-total // 6))
    order, token, out, n = ScanOrder(("o_custkey",), True), None, [], 0
    while True:
        page = query.scan_page(df, order, token, size, key="o_orderkey")
        last = page.select("o_custkey", "o_orderkey").offset(size - 1).limit(2).collect()  # the token and whether more follows
        out.append(page.limit(size).withColumn("page", F.lit(n).cast("bigint")))
        if len(last) < 2:
            break
        token, n = tuple(last[0]), n + 1
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result.select("page", "o_orderkey", "o_custkey")


def join_parent_children(spark: SparkSession, sf: str) -> DataFrame:
    parents, children = read(spark, sf, "customer").select("c_custkey", "c_name"), read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.parent_children(parents, children, "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


def latest_n_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.latest_per_parent(orders, "o_custkey", "o_orderdate", 5, "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


def semi_join_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return joins.rows_of(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ids, "o_custkey").select("o_orderkey", "o_custkey")


# Mutations: the state after.
def insert_many_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", "user_id")
    return mutate.with_ids(rows, 101, ["user_id", "event_id"])


def update_where(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return mutate.update_where(df, [P.lt("o_totalprice", 50000.0), P.ne("o_orderstatus", "F")], {"o_orderpriority": "0-SET", "unknown": 1})


def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.delete_where(labelled(spark, sf).select("doc_id", "lang", "quality"), [P.eq("quality", 1)])


def _totals(spark: SparkSession, sf: str, real: bool) -> DataFrame:
    """A table of counters keyed by (user_id, event_type): every customer's clicks; events come for some and for other keys."""
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"))
    ids = mutate.with_ids(users, 1, ["user_id"])
    return ids.withColumn("total", F.lit(0.5).cast("double") if real else F.lit(10).cast("bigint")).withColumn("last_id", F.lit(-1).cast("bigint"))


def _increments(real: bool, delta: str, done: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        calls = read(spark, sf, "events").select("user_id", "event_type", "event_id", F.expr(delta).alias("delta"), F.col("event_id").alias("last_id"))
        return done(mutate.upsert_increment(_totals(spark, sf, real), calls, ["user_id", "event_type"], "total", "delta", ["last_id"], "event_id", 1000000001))

    return run


upsert_increment_int = _increments(False, "1L")
upsert_increment_real = _increments(True, "value", lambda df: df.withColumn("total", F.round("total", 6)))
upsert_increment_mixed = _increments(True, "2L")  # integer deltas on a real counter give reals


def counter_wraps(spark: SparkSession, sf: str) -> DataFrame:
    top = F.lit(9223372036854775807) - F.col("o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", add_wrapping(top, F.col("o_custkey") * 1000).alias("total"))


def upsert_set(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by name, set anew; suppliers come in."""
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal")
    rows = read(spark, sf, "customer").select("c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    rows = rows.unionByName(read(spark, sf, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")))
    return mutate.upsert(customers, rows, ["c_name"], 1000000001)


def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.violations(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


# Snapshots: the table goes through a database in the shared folder.
def _db(spark: SparkSession) -> Database:
    return Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")


def _part_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price"), "p_brand")


def _parts(spark: SparkSession, sf: str) -> Database:
    db = _db(spark)
    db.create_table("part", [ColumnDef("name", DataType.TEXT), ColumnDef("size", DataType.INTEGER), ColumnDef("price", DataType.REAL)])
    db.insert_frame("part", _part_rows(spark, sf), ["p_partkey"])
    return db


def add_column_default(spark: SparkSession, sf: str) -> DataFrame:
    """Rows older than a column read its default; newer ones (the whole table once more) have their own value, also a null."""
    db = _parts(spark, sf)
    db.add_column("part", ColumnDef("tag", DataType.TEXT).default("untagged"))
    again = _part_rows(spark, sf).withColumn("tag", F.when(F.col("size") > 25, F.col("p_brand")))
    db.insert_frame("part", again, ["p_partkey"])
    return db.frame("part")


def rename_column(spark: SparkSession, sf: str) -> DataFrame:
    db = _parts(spark, sf)
    db.rename_column("part", "size", "extent")
    return db.frame("part")


def drop_column(spark: SparkSession, sf: str) -> DataFrame:
    db = _parts(spark, sf)
    db.drop_column("part", "size")
    return db.frame("part")


def drop_readd_column(spark: SparkSession, sf: str) -> DataFrame:
    """A column of an old name is a new one: old values don't come back."""
    db = _parts(spark, sf)
    db.drop_column("part", "size")
    db.add_column("part", ColumnDef("size", DataType.INTEGER).default(-1))
    return db.frame("part")


def snapshot_mutations(spark: SparkSession, sf: str) -> DataFrame:
    """Update, delete and a rolled-back transaction on a stored table."""
    db = _parts(spark, sf)
    db.update_where("part", [P.le("size", 10)], {"price": 1.0})
    db.delete_where("part", [P.gt("size", 40)])
    with db.begin() as tx:
        tx.delete_where("part", [])
    with db.begin() as tx:
        tx.update_where("part", [P.eq("size", 20)], {"name": "twenty"})
        tx.commit()
    return db.frame("part")


def _registry(spark: SparkSession) -> Database:
    db = _db(spark)
    db.create_table("users", [ColumnDef("name", DataType.TEXT), ColumnDef("age", DataType.INTEGER)])
    db.create_table("edges", [ColumnDef("a", DataType.TEXT), ColumnDef("b", DataType.TEXT), ColumnDef("n", DataType.INTEGER), ColumnDef("old", DataType.REAL)])
    db.create_index("edges", "by_pair", ["a", "b"], unique=True)
    db.create_index("users", "by_age", "age")
    db.drop_column("edges", "old")
    return db


def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t["name"], t["columns"], t["indexes"]) for t in _registry(spark).list_tables()], "name string, n_columns bigint, n_indexes bigint")


def list_columns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, c.name, c.type.value) for i, c in enumerate(_registry(spark).list_columns("edges"))], "pos bigint, name string, type string")


def list_indexes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i["name"], ",".join(i["columns"]), i["unique"]) for i in _registry(spark).list_indexes("edges")], "name string, columns string, is_unique boolean")


def encrypt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    db = _db(spark)
    db.create_table("customer", [ColumnDef("key", DataType.INTEGER), ColumnDef("name", DataType.TEXT), ColumnDef("balance", DataType.REAL)], key=bytes(range(32)))
    db.insert_frame("customer", read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), ["key"])
    again = Database(spark, db.store.root)
    again.unlock("customer", bytes(range(32)))
    return again.frame("customer").drop("_id")


# Vectors. The query vector is that of vec_id 0; a batch takes every id divisible by 50.
def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def _knn(metric: Metric, k: int = 10, filters: Sequence[P] = ()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _vectors(spark, sf)
        q = df.where("vec_id = 0").first()["vec"]
        near = vector.search(df, q, k, metric, filters, df if filters else None, "vec_id")
        return placed(near, [F.col("distance"), F.col("vec_id")]).select("pos", "vec_id", F.round("distance", 6).alias("distance"))

    return run


def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    near = vector.search_many(df, queries, 10, Metric.EUCLIDEAN, "vec_id")
    return near.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries by graphs: approximate, so tests hold its recall against the exact search."""
    df = _vectors(spark, sf)
    first = df.where("vec IS NOT NULL").first()
    size = len(first["vec"]) if first else 1
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    graphs = settled(ann.build(df, size, Metric.EUCLIDEAN, key="vec_id"))
    near = ann.search_many(graphs, queries, size, 10, 100, Metric.EUCLIDEAN, key="vec_id")
    return near.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


def _row(spark: SparkSession, df: DataFrame, row_id: int, key: str) -> DataFrame:
    found = query.get(df, row_id, key)
    return spark.createDataFrame([] if found is None else [found], df.schema)


# Through the database, as users call it. Single rows go into `nation`, which is small at every scale.
def _nations(spark: SparkSession, sf: str, **options: object) -> Database:
    db = _db(spark)
    db.create_table("nation", [ColumnDef("key", DataType.INTEGER), ColumnDef("name", DataType.TEXT), ColumnDef("region", DataType.INTEGER).default(-1)], **options)
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    db.insert_frame("nation", rows, ["key"])
    return db


def _customers(spark: SparkSession, sf: str) -> Database:
    """The whole table in one unit, and once more, with negative keys, in another."""
    db = _db(spark)
    db.create_table("customer", [ColumnDef("key", DataType.INTEGER), ColumnDef("segment", DataType.TEXT), ColumnDef("balance", DataType.REAL)])
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    db.insert_frame("customer", rows, ["key"])
    db.insert_frame("customer", rows.select((-F.col("key")).alias("key"), F.lit(None).cast("string").alias("segment"), "balance"), [F.col("key").desc()])
    return db


def db_find_page(spark: SparkSession, sf: str) -> DataFrame:
    found = _customers(spark, sf).find("customer", FindOptions([P.gt("balance", 0.0)], [[P.lt("segment", "F")], [P.eq("segment", "MACHINERY")]], [Sort.desc("balance"), Sort.asc("segment")], 40, 15, True))
    rows = placed(found.rows, [F.col("balance").desc_nulls_last(), F.col("segment").asc_nulls_first(), F.col("_id").asc()])
    return rows.withColumn("total", F.lit(found.total).cast("bigint"))


def db_find_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Ids prune units; the projection is the options'."""
    options = FindOptions([P.gt("_id", 10), P.ne("segment", "BUILDING")], columns=["_id", "segment"], ordered=False)
    return _customers(spark, sf).find("customer", options).rows


def db_get(spark: SparkSession, sf: str) -> DataFrame:
    db = _nations(spark, sf)
    rows = [db.get("nation", i) for i in (7, 3, 999)]
    return db.multi_get("nation", [2, 25, 2, 0]).unionByName(spark.createDataFrame([r for r in rows if r is not None], db.frame("nation").schema))


def db_count(spark: SparkSession, sf: str) -> DataFrame:
    db = _customers(spark, sf)
    groups = [[P.is_null("segment"), P.lt("balance", 100.0)], [P.eq("segment", "BUILDING")]]
    some = [("all", db.count("customer")), ("filtered", db.count("customer", [P.le("segment", "BUILDING")])), ("groups", db.count_with("customer", [P.gt("key", -50)], groups)), ("ids", db.count("customer", [P.in_list("_id", [1, 2, 2.0, 99999999])]))]
    return spark.createDataFrame(some, "what string, n bigint")


def db_scan_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 4 by id and by an index, descending."""
    db = _nations(spark, sf)
    db.create_index("nation", "by_region", "region")
    out = [(w, i, r["_id"]) for w, o in (("id", {}), ("index", {"index": "by_region", "descending": True})) for i, b in enumerate(db.scan_all("nation", 4, **o)) for r in b.rows]
    return spark.createDataFrame(out, "what string, page bigint, _id bigint")


def db_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Single rows: the next id, a given one, and the one after it; defaults, nulls and unknown columns."""
    db = _nations(spark, sf)
    db.insert("nation", {"key": 100, "name": "first", "unknown": 1})
    db.insert_with_id("nation", 1000, {"key": 101, "region": None})
    db.insert("nation", {"name": "third", "region": 7})
    return db.frame("nation")


def db_update_delete(spark: SparkSession, sf: str) -> DataFrame:
    db = _nations(spark, sf)
    db.update("nation", 3, {"name": "three", "region": None})
    db.update("nation", 999, {"name": "nobody"})
    db.delete("nation", 5)
    db.update_where("nation", [P.le("region", 1)], {"key": -1})
    db.delete_where("nation", [P.eq("_id", 7.0)])
    return db.frame("nation")


def db_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed writes: found and new keys; counters wrap, and new ones begin at the delta."""
    db = _nations(spark, sf)
    db.create_index("nation", "by_key", "key", unique=True)
    db.upsert("nation", {"key": 3}, {"name": "set"})
    db.upsert("nation", {"key": 300}, {"name": "new"})
    db.upsert_increment("nation", {"key": 4}, "region", 9223372036854775807, {"name": "counted"})
    db.upsert_increment("nation", {"key": 301}, "region", 5)
    calls = read(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.lit(2).cast("bigint").alias("d"), F.col("r_regionkey").alias("seq"))
    db.upsert_increment_frame("nation", calls.unionByName(calls.withColumn("key", F.lit(400).cast("bigint"))), ["key"], "region", "d", [], "seq")
    return db.frame("nation")


def db_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """A committed, a rolled-back and a light transaction, one with an error, and what a second version of the data reads."""
    db = _nations(spark, sf)
    with db.begin_acid() as tx:
        tx.update("nation", 1, {"name": "one"})
        tx.insert("nation", {"key": 50, "name": tx.get("nation", 1)["name"]})
        tx.commit()
    with db.begin_acid() as tx:
        tx.delete_where("nation", [])
        tx.rollback()
    try:
        db.transaction(lambda tx: (tx.update("nation", 2, {"name": "two"}), 1 / 0))
    except ZeroDivisionError:
        pass
    db.set_acid(False)
    with db.begin() as light:
        light.delete("nation", 3)
    return Database(spark, db.store.root).frame("nation")


def db_drops(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of tables, indexes and collections after drops and a reopening."""
    db = _nations(spark, sf)
    db.create_table("gone", [ColumnDef("x", DataType.BLOB)])
    db.create_index("nation", "a", "key")
    db.create_index("nation", "b", ["region", "key"])
    db.drop_index("nation", "a")
    db.create_collection("nation", "v", 2)
    db.create_collection("nation", "w", 3, Metric.DOT)
    db.drop_collection("nation", "v")
    db.drop_table("gone")
    db.vacuum()
    again = Database(spark, db.store.root).snapshot()
    rows = [("table", t["name"]) for t in again.list_tables()] + [("index", i["name"]) for i in again.list_indexes("nation")] + [("collection", c["name"]) for c in again.manifest["collections"]]
    return spark.createDataFrame(rows, "kind string, name string")


def _collection(key: bytes | None) -> Query:
    """A collection over the whole table: batch and single inserts, an update, a delete, reopening, a filtered search."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        db = _db(spark)
        vectors = read(spark, sf, "embeddings")
        db.create_table("items", [ColumnDef("vec_id", DataType.INTEGER), ColumnDef("label", DataType.INTEGER)], key)
        db.insert_frame("items", vectors.select("vec_id", F.col("label").cast("bigint").alias("label")), ["vec_id"])
        size = len(vectors.where("vec_id = 0").first()["embedding"])
        db.create_collection("items", "v", size, Metric.EUCLIDEAN)
        rows = db.frame("items").join(vectors.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("_id", "vec")
        db.insert_vectors_frame("items", "v", rows)
        db.delete_vector("items", "v", 2)
        db.update_vector("items", "v", 3, [0.5] * size)
        again = Database(spark, db.store.root)
        if key:
            again.unlock("items", key)
        near = again.vector_search("items", "v", [0.25] * size, 12, where=P.le("label", 4))
        near = near.join(again.frame("items"), "_id").select("vec_id", "distance")
        return placed(near, [F.col("distance"), F.col("vec_id")]).select("pos", "vec_id", F.round("distance", 6).alias("distance"))

    return run


def db_async(spark: SparkSession, sf: str) -> DataFrame:
    """The asynchronous facade: transactions that read what they wrote, one rolled back, and vectors."""
    import asyncio

    from ..aio import AsyncDatabase

    async def work(db: AsyncDatabase) -> None:
        await db.create_index("nation", "by_key", "key", unique=True)

        async def one() -> None:
            async with db.begin() as tx:
                await tx.upsert_increment("nation", {"key": 2}, "region", 10)
                await tx.commit()

        await asyncio.gather(one(), one())
        async with db.begin() as tx:
            await tx.delete_where("nation", [])
        async with db.begin() as tx:
            i = await tx.insert("nation", {"key": 60, "name": "x"})
            await tx.update("nation", i, {"name": (await tx.get("nation", i))["name"] + "y"})
            await tx.commit()
        await db.create_collection("nation", "v", 2)
        await db.insert_vectors("nation", "v", {1: [1.0, 0.0], 4: [0.0, 1.0]})
        near = (await db.vector_search("nation", "v", [1.0, 0.1], 1)).first()["_id"]
        await db.delete("nation", near)

    db = _nations(spark, sf)
    asyncio.run(work(AsyncDatabase(db)))
    return db.frame("nation")


DATABASE: dict[str, Query] = {
    "db_find_page": db_find_page,
    "db_find_filtered": db_find_filtered,
    "db_get": db_get,
    "db_count": db_count,
    "db_scan_batch": db_scan_batch,
    "db_insert": db_insert,
    "db_update_delete": db_update_delete,
    "db_upsert": db_upsert,
    "db_transactions": db_transactions,
    "db_drops": db_drops,
    "db_collection": _collection(None),
    "db_collection_encrypted": _collection(bytes(range(32))),
    "db_async": db_async,
}

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
OR_GROUPS = [[P.eq("o_orderstatus", "F"), P.gt("o_totalprice", 300000.0)], [P.in_list("o_orderpriority", ["1-URGENT"]), P.lt("o_totalprice", 20000.0)]]

QUERIES: dict[str, Query] = {
    "find_eq": _found("orders", "o_orderkey", ORDER, [P.eq("o_orderstatus", "F")]),
    "find_ne": _found("orders", "o_orderkey", ORDER, [P.ne("o_orderstatus", "F")]),
    "find_lt": _found("orders", "o_orderkey", ORDER, [P.lt("o_totalprice", 60000)]),
    "find_le": _found("part", "p_partkey", ["p_partkey", "p_size"], [P.le("p_size", 10)]),
    "find_gt": _found("part", "p_partkey", ["p_partkey", "p_size"], [P.gt("p_size", 40.5)]),
    "find_ge": _found("orders", "o_orderkey", ORDER, [P.ge("o_totalprice", 400000.0)]),
    "find_in": _found("customer", "c_custkey", ["c_custkey", "c_mktsegment"], [P.in_list("c_mktsegment", ["BUILDING", "MACHINERY", 3])]),
    "find_in_empty": _found("customer", "c_custkey", ["c_custkey", "c_mktsegment"], [P.in_list("c_mktsegment", [])]),
    "find_in_with_null": _labelled([P.in_list("quality", [0, None])]),
    "find_is_null": _labelled([P.is_null("quality")]),
    "find_is_not_null": _labelled([P.is_not_null("toxic")]),
    "find_eq_null": _labelled([P.eq("quality", None)]),
    "find_ge_null": _labelled([P.ge("quality", None), P.eq("lang", "en")]),
    "find_ne_null_rows": _labelled([P.ne("quality", 1)]),
    "find_lt_null_rows": _labelled([P.lt("quality", 1)]),
    "find_type_mismatch": _labelled([P.ne("quality", "1")]),
    "find_unknown_column": _labelled([P.is_null("nowhere"), P.eq("lang", "de")]),
    "find_and": _found("orders", "o_orderkey", ORDER, [P.eq("o_orderstatus", "O"), P.ge("o_totalprice", 200000.0), P.lt("o_custkey", 700)]),
    "find_or_groups": _found("orders", "o_orderkey", ORDER, [P.ne("o_custkey", 1)], OR_GROUPS),
    "find_or_empty_group": _found("orders", "o_orderkey", ORDER, [P.eq("o_orderstatus", "P")], [[P.eq("o_custkey", 1)], []]),
    "find_keyset_or": _found("orders", "o_orderkey", ORDER, (), [[P.gt("o_custkey", 500)], [P.eq("o_custkey", 500), P.gt("o_orderkey", 1000)]]),
    "find_sort_multi": _page("orders", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], [Sort.asc("o_orderstatus"), Sort.desc("o_totalprice")], 200),
    "find_sort_nulls_asc": _labelled_page([Sort.asc("quality"), Sort.desc("lang")], 500, "quality"),
    "find_sort_nulls_desc": _labelled_page([Sort.desc("quality")], 500),
    "find_sort_unknown": _page("orders", "o_orderkey", ["o_orderkey"], [Sort.desc("nowhere")], 50),
    "find_offset_limit": _page("lineitem", "l_orderkey", ["l_orderkey", "l_linenumber", "l_extendedprice"], [Sort.desc("l_extendedprice"), Sort.asc("l_linenumber"), Sort.asc("l_partkey"), Sort.asc("l_suppkey")], 100, 50, [P.eq("l_returnflag", "R")]),
    "find_with_total": find_with_total,
    "get_by_id": lambda spark, sf: _row(spark, read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), 42, "c_custkey"),
    "multi_get": lambda spark, sf: query.multi_get(read(spark, sf, "customer").select("c_custkey", "c_name"), [3, 1, 99, 1, 123456789], "c_custkey"),
    "count_all": _count("lineitem"),
    "count_eq": _count("events", [P.eq("event_type", "click")]),
    "count_or_groups": _count("lineitem", [P.gt("l_quantity", 10.0)], [[P.eq("l_returnflag", "R")], [P.eq("l_linestatus", "O"), P.lt("l_discount", 0.02)]]),
    "scan_pk_page2_asc": _scan(ScanOrder(), (500,), 100),
    "scan_pk_desc": _scan(ScanOrder((), True), (9000,), 100),
    "scan_index_asc": _scan(ScanOrder(("o_custkey",)), (100, 50), 200),
    "scan_index_desc_filtered": _scan(ScanOrder(("o_custkey",), True), (900, 5000), 150, [P.eq("o_orderstatus", "F")]),
    "scan_all_pages": scan_all_pages,
    "join_parent_children": join_parent_children,
    "latest_n_per_parent": latest_n_per_parent,
    "semi_join_ids": semi_join_ids,
    "insert_many_ids": insert_many_ids,
    "update_where": update_where,
    "delete_where": delete_where,
    "upsert_set": upsert_set,
    "upsert_increment_int": upsert_increment_int,
    "upsert_increment_real": upsert_increment_real,
    "upsert_increment_mixed": upsert_increment_mixed,
    "counter_wraps": counter_wraps,
    "unique_violations": unique_violations,
    "add_column_default": add_column_default,
    "rename_column": rename_column,
    "drop_column": drop_column,
    "drop_readd_column": drop_readd_column,
    "snapshot_mutations": snapshot_mutations,
    "list_tables": list_tables,
    "list_columns": list_columns,
    "list_indexes": list_indexes,
    "encrypt_roundtrip": encrypt_roundtrip,
    "knn_cosine": _knn(Metric.COSINE),
    "knn_euclidean": _knn(Metric.EUCLIDEAN),
    "knn_dot": _knn(Metric.DOT),
    "knn_filtered": _knn(Metric.COSINE, 10, [P.eq("label", 3)]),
    "knn_selective_filter": _knn(Metric.EUCLIDEAN, 5, [P.in_list("vec_id", [7, 11, 13, 17, 19])]),
    "knn_batch": knn_batch,
    "knn_graph": knn_graph,
    **DATABASE,
}
