from __future__ import annotations

import asyncio
import random

import pytest
from pyspark.sql import functions as F

from tessera import ColumnDef, Database, DataType, Durability, Filter, FindOptions, Metric, Sort
from tessera import types as E
from tessera.aio import AsyncDatabase

T, I, R = DataType.TEXT, DataType.INTEGER, DataType.REAL


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def rows(db, name, *filters):
    return [tuple(r) for r in db.find(name, FindOptions(filters=filters)).rows.collect()]


def test_rows_and_reopening(spark, db):
    db.create_table("users", [ColumnDef("name", T), ColumnDef("age", I).default(7)])
    assert db.insert("users", {"name": "a", "unknown": 1}) == 1
    assert db.insert_many("users", [{"name": "b", "age": None}, {"name": "c", "age": 3}]) == [2, 3]
    assert db.insert_with_id("users", 10, {"name": "d"}) == 10
    assert db.insert("users", {"name": "e", "age": 1}) == 11
    with pytest.raises(E.DuplicateKey):
        db.insert_with_id("users", 10, {})
    with pytest.raises(E.TypeMismatch):
        db.insert("users", {"name": 5})
    again = Database(spark, db.store.root)
    assert rows(again, "users") == [(1, "a", 7), (2, "b", None), (3, "c", 3), (10, "d", 7), (11, "e", 1)]
    assert again.get("users", 3)["name"] == "c" and again.get("users", 4) is None
    assert again.count("users") == 5 and again.count("users", [Filter.le("age", 3)]) == 3
    found = db.find("users", FindOptions(sort=[Sort.desc("age")], limit=2, offset=1, include_total=True))
    assert [r["name"] for r in found.rows.collect()] == ["d", "c"] and found.total == 5
    assert [r["_id"] for r in db.multi_get("users", [11, 2, 2]).collect()] == [2, 11]
    assert db.list_tables() == [{"name": "users", "columns": 2, "indexes": 0}]
    db.drop_table("users")
    with pytest.raises(E.TableNotFound):
        db.count("users")


def test_update_delete(db):
    db.create_table("t", [ColumnDef("k", T), ColumnDef("v", I)])
    db.insert_many("t", [{"k": x, "v": i} for i, x in enumerate("aabbc")])
    assert db.update_where("t", [Filter.eq("k", "a")], {"v": 9}) == 2
    assert db.update("t", 5, {"k": None}) and not db.update("t", 99, {"k": "x"})
    assert db.delete_where("t", [Filter.lt("k", "b")]) == 3  # a, a and the null
    assert db.delete("t", 3) and not db.delete("t", 3)
    assert rows(db, "t") == [(4, "b", 3)]
    db.compact("t")
    assert rows(db, "t") == [(4, "b", 3)] and db.count("t") == 1


def test_evolution(db):
    db.create_table("t", [ColumnDef("a", T), ColumnDef("b", I)])
    db.insert("t", {"a": "x", "b": 1})
    db.add_column("t", ColumnDef("c", I).default(99))
    db.insert_many("t", [{"a": "y"}, {"a": "z", "c": None}])
    assert rows(db, "t") == [(1, "x", 1, 99), (2, "y", None, 99), (3, "z", None, None)]
    db.rename_column("t", "b", "bb")
    db.create_index("t", "by", ["bb"])
    with pytest.raises(E.SchemaError):
        db.drop_column("t", "bb")
    db.drop_index("t", "by")
    db.drop_column("t", "bb")
    db.add_column("t", ColumnDef("bb", T))
    assert [c.name for c in db.list_columns("t")] == ["a", "c", "bb"]
    assert rows(db, "t")[0] == (1, "x", 99, None)
    for bad in (ColumnDef("a", T), ColumnDef("", T), ColumnDef("q", T).not_null()):
        with pytest.raises(E.SchemaError):
            db.add_column("t", bad)


def test_indexes_and_upserts(db):
    db.create_table("edges", [ColumnDef("a", T), ColumnDef("b", T), ColumnDef("n", I), ColumnDef("note", T)])
    with pytest.raises(E.SchemaError):
        db.upsert("edges", {"a": "x"}, {})
    db.create_index("edges", "pair", ["a", "b"], unique=True)
    db.insert("edges", {"a": "x", "b": "y", "n": 1})
    with pytest.raises(E.UniqueViolation):
        db.insert("edges", {"a": "x", "b": "y"})
    assert db.insert_many("edges", [{"a": "x"}, {"a": "x"}]) == [2, 3]  # a null component exempts; the failed id came back
    assert db.upsert("edges", {"b": "y", "a": "x"}, {"note": "seen"}) == 1
    assert db.upsert_increment("edges", {"a": "x", "b": "y"}, "n", (1 << 63) - 1, {"note": "again"}) == 1
    assert db.get("edges", 1)["n"] == -(1 << 63)
    assert db.upsert_increment("edges", {"a": "p", "b": "q"}, "n", 4) == 4
    with pytest.raises(E.UniqueViolation):
        db.update("edges", 4, {"a": "x", "b": "y"})
    with pytest.raises(E.UniqueViolation):
        db.create_index("edges", "a", "a", unique=True)
    calls = db.spark.createDataFrame([(1, "p", "q", 3, "one"), (2, "new", "k", 5, "two"), (3, "p", "q", 1, "three")], "seq long, a string, b string, d long, note string")
    db.upsert_increment_frame("edges", calls, ["a", "b"], "n", "d", ["note"], "seq")
    assert [tuple(r) for r in db.frame("edges").where("_id > 3").orderBy("_id").collect()] == [(4, "p", "q", 8, "three"), (5, "new", "k", 5, "two")]
    assert db.list_indexes("edges") == [{"name": "pair", "columns": ["a", "b"], "unique": True}]


@pytest.mark.parametrize("descending", [False, True])
def test_cursor_tiles(db, descending):
    db.create_table("s", [ColumnDef("score", I)])
    db.insert_many("s", [{"score": x} for x in (30, 10, 50, None, 20, 70, 40, 60, 10)])
    db.create_index("s", "by", "score")
    pages = list(db.scan_all("s", 4, index="by", descending=descending))
    got = [(r["score"], r["_id"]) for p in pages for r in p.rows]
    want = sorted(((x, i + 1) for i, x in enumerate((30, 10, 50, None, 20, 70, 40, 60, 10)) if x is not None), reverse=descending)
    assert got == want and [len(p.rows) for p in pages] == [4, 4]
    with pytest.raises(E.IndexNotFound):
        db.scan_batch("s", index="none")


def test_transactions(spark, db):
    db.create_table("t", [ColumnDef("v", I)])
    with db.begin() as tx:
        tx.insert("t", {"v": 1})
        assert tx.count("t") == 1 and db.count("t") == 0
    assert db.count("t") == 0
    with db.begin() as tx:
        tx.insert_many("t", [{"v": 1}, {"v": 2}])
        tx.delete("t", 1)
        tx.commit()
    assert rows(db, "t") == [(2, 2)]
    with pytest.raises(E.TransactionClosed):
        tx.count("t")
    a, b = db.begin(), db.begin()
    a.insert("t", {"v": 3})
    b.insert("t", {"v": 4})
    a.commit()
    with pytest.raises(E.TransactionConflict):
        b.commit()
    db.set_acid(False)
    with db.begin() as light:
        light.insert("t", {"v": 5})
    assert db.count("t") == 3
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.insert("t", {"v": 6}), 1 / 0))
    assert db.count("t") == 4
    pinned = db.snapshot()
    db.delete_where("t", [])
    assert db.count("t") == 0 and pinned.frame("t").count() == 4


def test_limits_and_paths(spark, db):
    db.set_max_row_size(20)
    db.create_table("t", [ColumnDef("v", T)])
    with pytest.raises(E.RowTooLarge):
        db.insert("t", {"v": "x" * 50})
    for bad in ("", "a/../b", "a\0b"):
        with pytest.raises(E.InvalidPath):
            Database(spark, bad)


def test_encryption(spark, db):
    key = bytes(range(32))
    db.create_table("s", [ColumnDef("t", T), ColumnDef("b", DataType.BLOB), ColumnDef("r", R)], key=key)
    db.insert("s", {"t": "hidden", "b": b"\x00\xff", "r": float("nan")})
    again = Database(spark, db.store.root)
    with pytest.raises(E.EncryptionRequired):
        again.count("s", [Filter.eq("t", "x")])
    with pytest.raises(E.InvalidKey):
        again.unlock("s", bytes(32))
    again.unlock("s", key)
    row = again.get("s", 1)
    assert (row["t"], bytes(row["b"])) == ("hidden", b"\x00\xff") and row["r"] != row["r"]
    db.create_table("plain", [])
    with pytest.raises(E.SchemaError):
        db.unlock("plain", key)


def test_vectors(db):
    db.create_table("items", [ColumnDef("name", T)])
    db.insert_many("items", [{"name": "AB"[i % 2]} for i in range(6)])
    db.create_collection("items", "v", 2, Metric.EUCLIDEAN)
    db.insert_vectors("items", "v", {i: [float(i), 0.0] for i in range(1, 6)})
    near = lambda **o: [(r[0], r[1]) for r in db.vector_search("items", "v", [1.0, 0.0], **o).collect()]
    assert near(k=2) == [(1, 0.0), (2, 1.0)]
    assert near(k=9, where=Filter.eq("name", "B")) == [(2, 1.0), (4, 9.0)]
    assert near(k=9, where=Filter.gt("_id", 4)) == [(5, 16.0)]
    db.update_vector("items", "v", 5, [1.0, 0.5])
    db.delete_vector("items", "v", 1)
    assert near(k=1) == [(5, 0.25)]
    assert db.collection_info("items", "v")["len"] == 4
    for error, call in ((E.DimensionMismatch, lambda: db.insert_vector("items", "v", 6, [1.0])), (E.VectorExists, lambda: db.insert_vector("items", "v", 2, [1.0, 1.0])), (E.StorageError, lambda: db.insert_vector("items", "v", 77, [1.0, 1.0])), (E.VectorNotFound, lambda: db.delete_vector("items", "v", 1)), (E.CollectionNotFound, lambda: db.vectors("items", "w"))):
        with pytest.raises(error):
            call()


def test_random_mutations_against_a_model(db):
    r, model, next_id = random.Random(5), {}, 1
    db.create_table("m", [ColumnDef("k", T), ColumnDef("v", I)])
    for _ in range(12):
        what, k = r.choice(["insert", "update", "delete"]), r.choice("abc")
        if what == "insert":
            new = [{"k": r.choice(["a", "b", None]), "v": r.randint(0, 9)} for _ in range(3)]
            for i, x in zip(db.insert_many("m", new), new, strict=True):
                assert i == next_id
                model[i], next_id = (x["k"], x["v"]), next_id + 1
        elif what == "update":
            hit = [i for i, x in model.items() if x[0] is None or x[0] < k]
            assert db.update_where("m", [Filter.lt("k", k)], {"v": -1}) == len(hit)
            model |= {i: (model[i][0], -1) for i in hit}
        else:
            hit = [i for i, x in model.items() if x[1] == 3]
            assert db.delete_where("m", [Filter.eq("v", 3)]) == len(hit)
            for i in hit:
                del model[i]
    assert rows(db, "m") == [(i, *x) for i, x in sorted(model.items())]


def test_async_counters(spark, tmp_path):
    async def work():
        db = await AsyncDatabase.open(spark, f"file://{tmp_path}/adb")
        await db.create_table("c", [ColumnDef("key", T), ColumnDef("value", I)])
        await db.create_index("c", "by", "key", unique=True)

        async def one():
            async with db.begin() as tx:
                await tx.upsert_increment("c", {"key": "k"}, "value", 1)
                await tx.commit()

        await asyncio.gather(*(one() for _ in range(3)))
        return (await db.frame("c")).collect()

    assert [r["value"] for r in asyncio.run(work())] == [3]


def test_stream_folds_into_counters(spark, db, tmp_path):
    from tessera.streaming.counters import increments_into, stream_of

    db.create_table("c", [ColumnDef("user", I), ColumnDef("n", I), ColumnDef("last", I)])
    db.create_index("c", "by", "user", unique=True)
    for i in range(2):
        spark.range(6).select((F.col("id") % 3).alias("user"), F.lit(1).cast("long").alias("d"), (F.col("id") + 10 * i).alias("last")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_of(spark, f"{tmp_path}/in", "user long, d long, last long").withColumn("seq", F.col("last"))
    increments_into(stream, db, "c", ["user"], "n", "d", ["last"], "seq", f"{tmp_path}/check").awaitTermination(120)
    assert [tuple(r)[1:] for r in db.frame("c").orderBy("user").collect()] == [(0, 4, 13), (1, 4, 14), (2, 4, 15)]


def test_ids_of_other_types_and_strict_frames(spark, db):
    db.create_table("t", [ColumnDef("a", T), ColumnDef("n", I), ColumnDef("r", R).default(1.5)])
    db.insert_many("t", [{"a": "x", "n": 1}, {"a": "y", "n": 2}])
    for f, n in ((Filter.in_list("_id", [1.0]), 1), (Filter.eq("_id", 1.0), 1), (Filter.in_list("_id", [1, "1", None]), 1), (Filter.gt("_id", 1.5), 1), (Filter.eq("_id", True), 0)):
        assert db.count("t", [f]) == n
    frame = lambda row, schema: spark.createDataFrame([row], schema)
    for row, schema in ((("x", "12"), "a string, n string"), (("x", 1.9), "a string, n double"), ((5, 1), "a long, n long"), (("x", 1, True), "a string, n long, r boolean")):
        with pytest.raises(E.TypeMismatch):
            db.insert_frame("t", frame(row, schema), ["n"])
    db.insert_frame("t", frame(("z", 3, 4), "a string, n int, r int"), ["n"])
    assert rows(db, "t")[-1] == (3, "z", 3, 4.0)
    db.set_max_row_size(40)
    with pytest.raises(E.RowTooLarge):
        db.insert_frame("t", frame(("x" * 500, 4), "a string, n long"), ["n"])
    assert db.count("t") == 3


def test_increments_of_frames(spark, db):
    db.create_table("c", [ColumnDef("k", T), ColumnDef("n", I), ColumnDef("note", T).default("dflt"), ColumnDef("code", I)])
    db.create_index("c", "by_k", "k", unique=True)
    db.create_index("c", "by_code", "code", unique=True)
    db.insert("c", {"k": "a", "n": 1, "code": 7})
    calls = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "b", 1)], "seq long, k string, d long")
    args = ("c", calls, ["k"], "n", "d", [], "seq")
    assert db.increments_once("source", 0, *args) and not db.increments_once("source", 0, *args)  # a batch that is run again
    assert rows(db, "c") == [(1, "a", 3, "dflt", 7), (2, "b", 4, "dflt", None)]
    assert db.increments_once("other", 0, *args)
    with pytest.raises(E.UniqueViolation):
        db.upsert_increment_frame("c", spark.createDataFrame([(1, "z", 1, 7)], "seq long, k string, d long, code long"), ["k"], "n", "d", ["code"], "seq")
    assert rows(db, "c") == [(1, "a", 5, "dflt", 7), (2, "b", 8, "dflt", None)]


def test_vacuum_and_pages(spark, db):
    db.create_table("t", [ColumnDef("v", I)])
    for i in range(3):
        db.insert_many("t", [{"v": 10 * i + j} for j in range(4)])
    assert [[r["_id"] for r in b.rows] for b in db.scan_all("t", 5)] == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12]]
    assert [[r["_id"] for r in b.rows] for b in db.scan_all("t", 5, descending=True)] == [[12, 11, 10, 9, 8], [7, 6, 5, 4, 3], [2, 1]]
    db.compact("t")
    assert db.vacuum() == (4, 3) and db.count("t", [Filter.ge("v", 0)]) == 12
    assert Database(spark, db.store.root).count("t") == 12 and db.vacuum() == (0, 0)


def test_parallel_writers(spark, tmp_path):
    """Writers on threads: every row is there once, ids are unique."""
    from concurrent.futures import ThreadPoolExecutor

    db = Database(spark, f"file://{tmp_path}/many", Durability.IMMEDIATE)
    db.create_table("t", [ColumnDef("v", I)])
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: db.insert_many("t", [{"v": 10 * i + j} for j in range(3)]), range(4)))
    got = rows(db, "t")
    assert sorted(v for _, v in got) == sorted(10 * i + j for i in range(4) for j in range(3)) and len({i for i, _ in got}) == 12
    n = db.insert_frame("t", spark.range(100_000).select(F.col("id").alias("v")), ["v"])
    assert n == 100_000 and db.delete_where("t", [Filter.ge("v", 50)]) == 99_950 and db.count("t") == 62


def test_encrypted_collections(spark, db):
    key = bytes(range(32))
    db.create_table("s", [ColumnDef("t", T)], key=key)
    db.insert_many("s", [{"t": "a"}, {"t": "b"}])
    db.create_collection("s", "v", 2)
    db.insert_vectors("s", "v", {1: [1.0, 0.0]})
    db.insert_vectors_frame("s", "v", spark.createDataFrame([(2, [0.0, 1.0])], "_id long, vec array<float>"))
    again = Database(spark, db.store.root)
    with pytest.raises(E.EncryptionRequired):
        again.vector_search("s", "v", [1.0, 0.0])
    again.unlock("s", key)
    assert [r[0] for r in again.vector_search("s", "v", [0.1, 1.0], 1).collect()] == [2]
    for bad, error in (((2, [1.0, 1.0]), E.VectorExists), ((9, [1.0, 1.0]), E.StorageError), ((1, [1.0]), E.DimensionMismatch)):
        with pytest.raises(error):
            again.insert_vectors_frame("s", "v", spark.createDataFrame([bad], "_id long, vec array<float>"))
