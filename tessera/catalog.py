"""Databases: tables, schema evolution, indexes, mutations, transactions, encryption and vector collections."""

from __future__ import annotations

import base64
import copy
import enum
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as E
from .functions.counters import wrap_int
from .functions.distance import Metric
from .operators import ann, mutate, query, vector
from .operators.query import Batch, FindOptions, FindResult, ScanOrder
from .predicate import Filter, compile_all
from .sources.steps import settled
from .sources.storage import Store
from .types import ColumnDef, DataType

ID = "_id"
CHECK = "tessera key check"
#: Bytes of one row at most.
DEFAULT_MAX_ROW = 10 * 1024 * 1024


class Durability(enum.Enum):
    IMMEDIATE = "immediate"  # units and manifests are synced before a commit returns
    NORMAL = "normal"
    NONE = "none"  # like NORMAL: a commit needs its files closed


def _plain(v: Any) -> Any:
    return {"b": base64.b64encode(v).decode()} if isinstance(v, bytes) else {"f": repr(v)} if isinstance(v, float) else v


def _value(v: Any) -> Any:
    return (base64.b64decode(v["b"]) if "b" in v else float(v["f"])) if isinstance(v, dict) else v


def _def(c: dict) -> ColumnDef:
    return ColumnDef(c["name"], DataType(c["type"]), c["nullable"], c["unique"], _value(c["default"]), c["col_id"], c["dropped"])


def _entry(c: ColumnDef, col_id: int) -> dict:
    return {"name": c.name, "type": c.type.value, "nullable": c.nullable, "unique": c.is_unique, "default": _plain(c.default_value), "col_id": col_id, "dropped": False}


class Snapshot:
    """One version of all tables, and what a transaction stages on it. All reads see what was staged before."""

    def __init__(self, store: Store, version: int, manifest: dict, keys: dict[str, bytes], max_row: int = DEFAULT_MAX_ROW) -> None:
        self.store, self.version, self.manifest, self.keys, self.max_row = store, version, manifest, keys, max_row
        self.spark = store.spark

    # Metadata
    def table(self, name: str) -> dict:
        if name not in self.manifest["tables"]:
            raise E.TableNotFound(name)
        return self.manifest["tables"][name]

    def _open(self, name: str) -> dict:
        t = self.table(name)
        if t["check"] and name not in self.keys:
            raise E.EncryptionRequired(f"{name} is locked")
        return t

    def live(self, name: str) -> list[ColumnDef]:
        return [_def(c) for c in self.table(name)["columns"] if not c["dropped"]]

    def list_tables(self) -> list[dict]:
        return [{"name": n, "columns": sum(not c["dropped"] for c in t["columns"]), "indexes": len(t["indexes"])} for n, t in sorted(self.manifest["tables"].items())]

    def list_columns(self, name: str) -> list[ColumnDef]:
        return self.live(name)

    def list_indexes(self, name: str) -> list[dict]:
        names = {c["col_id"]: c["name"] for c in self.table(name)["columns"]}
        return [{"name": i["name"], "columns": [names[c] for c in i["columns"]], "unique": i["unique"]} for i in self.table(name)["indexes"]]

    # Tables and columns
    def create_table(self, name: str, columns: Sequence[ColumnDef], key: bytes | None = None) -> None:
        if name in self.manifest["tables"]:
            raise E.TableExists(name)
        seen: set[str] = set()
        for c in columns:
            self._check_name(c.name, seen)
            seen.add(c.name)
        check = None
        if key is not None:
            self._check_key(key)
            check = base64.b64encode(self._one(F.aes_encrypt(F.lit(CHECK), F.lit(key), F.lit("GCM")))).decode()
            self.keys[name] = key
        self.manifest["tables"][name] = {"columns": [_entry(c, i) for i, c in enumerate(columns)], "indexes": [], "units": [], "next_id": 1, "rows": 0, "check": check}

    @staticmethod
    def _check_name(name: str, taken: set[str]) -> None:
        if not name or "\0" in name or name == ID:
            raise E.SchemaError(f"{name!r} can't be a column's name")
        if name in taken:
            raise E.ColumnExists(name)

    def drop_table(self, name: str) -> None:
        self.table(name)
        del self.manifest["tables"][name]
        self.manifest["collections"] = [c for c in self.manifest["collections"] if c["table"] != name]

    def add_column(self, name: str, column: ColumnDef) -> None:
        t = self._open(name)
        self._check_name(column.name, {c.name for c in self.live(name)})
        if not column.nullable and column.default_value is None and t["rows"]:
            raise E.SchemaError(f"{column.name} is not null and has no default, but {name} has rows")
        t["columns"].append(_entry(column, len(t["columns"])))

    def _column(self, name: str, column: str) -> dict:
        for c in self._open(name)["columns"]:
            if c["name"] == column and not c["dropped"]:
                return c
        raise E.ColumnNotFound(column)

    def rename_column(self, name: str, old: str, new: str) -> None:
        c = self._column(name, old)
        self._check_name(new, {x.name for x in self.live(name)} - {old})
        c["name"] = new

    def drop_column(self, name: str, column: str) -> None:
        c = self._column(name, column)
        if any(c["col_id"] in i["columns"] for i in self.table(name)["indexes"]):
            raise E.SchemaError(f"an index uses {column}")
        c["dropped"] = True

    # Reading
    def _unit(self, name: str, t: dict, units: list[dict], columns: list[dict]) -> DataFrame:
        """Units that hold the same columns, with what they lack filled by defaults."""
        held = set(units[0]["col_ids"])
        fields = [(f"c{c['col_id']}", DataType(c["type"]).spark) for c in t["columns"] if c["col_id"] in held]
        stored = T.StructType([T.StructField(ID, T.LongType()), *(T.StructField(n, k) for n, k in fields)])
        paths = [self.store.path(u["path"]) for u in units]
        if t["check"]:
            raw = self.spark.read.schema(T.StructType([T.StructField(ID, T.LongType()), T.StructField("payload", T.BinaryType())])).parquet(*paths)
            body = F.from_json(F.aes_decrypt("payload", F.lit(self.keys[name]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(name)).cast("string"), T.StructType([T.StructField(n, T.StringType() if isinstance(k, T.BinaryType) else k) for n, k in fields]))
            df = raw.select(ID, body.alias("b")).select(ID, *((F.unbase64(f"b.{n}") if isinstance(k, T.BinaryType) else F.col(f"b.{n}")).alias(n) for n, k in fields))
        else:
            df = self.spark.read.schema(stored).parquet(*paths)
        fill = [F.col(f"c{c['col_id']}") if c["col_id"] in held else F.lit(_value(c["default"])).cast(DataType(c["type"]).spark) for c in columns]
        return df.select(ID, *(x.alias(c["name"]) for x, c in zip(fill, columns, strict=True)))

    def frame(self, name: str, units: list[dict] | None = None) -> DataFrame:
        """The table as a frame: _id and the live columns. One scan for each set of columns that units hold."""
        t = self._open(name)
        columns = [c for c in t["columns"] if not c["dropped"]]
        units = t["units"] if units is None else units
        groups: dict[tuple, list[dict]] = {}
        for u in units:
            groups.setdefault(tuple(u["col_ids"]), []).append(u)
        if not groups:
            return self.spark.createDataFrame([], T.StructType([T.StructField(ID, T.LongType()), *(T.StructField(c["name"], DataType(c["type"]).spark) for c in columns)]))
        return reduce(DataFrame.unionByName, [self._unit(name, t, g, columns) for g in groups.values()])

    def _near(self, name: str, filters: Sequence[Filter]) -> list[dict]:
        """Units that filters on _id don't rule out."""
        units = self._open(name)["units"]
        for f in filters:
            values = f.value if isinstance(f.value, tuple) else (f.value,)
            if f.column != ID or any(isinstance(v, bool) or not isinstance(v, int) for v in values):
                continue  # only whole numbers rule units out
            if f.op in ("eq", "in"):
                units = [u for u in units if any(u["low"] <= v <= u["high"] for v in values)]
            elif f.op in ("gt", "ge"):
                units = [u for u in units if u["high"] >= values[0]]
            elif f.op in ("lt", "le"):
                units = [u for u in units if u["low"] <= values[0]]
        return units

    def find(self, name: str, options: FindOptions | None = None) -> FindResult:
        o = options or FindOptions()
        return query.find(self.frame(name, self._near(name, o.filters)), o)

    def get(self, name: str, row_id: int) -> Row | None:
        return query.get(self.frame(name, self._near(name, [Filter.eq(ID, row_id)])), row_id)

    def multi_get(self, name: str, ids: Sequence[int]) -> DataFrame:
        return query.multi_get(self.frame(name, self._near(name, [Filter.in_list(ID, ids)])), ids)

    def count(self, name: str, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = ()) -> int:
        if not filters and not or_groups:
            return self._open(name)["rows"]
        return query.count(self.frame(name, self._near(name, filters)), filters, or_groups)

    count_with = count

    def scan_batch(self, name: str, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = (), index: str | None = None, descending: bool = False, after: Sequence[Any] | None = None, limit: int = 1000) -> Batch:
        columns: tuple[str, ...] = ()
        if index is not None:
            found = [i for i in self.list_indexes(name) if i["name"] == index]
            if not found:
                raise E.IndexNotFound(index)
            columns = tuple(found[0]["columns"])
        units = self._near(name, filters)
        if not columns and after is not None:  # a page by _id: units before the token are done
            units = [u for u in units if (u["low"] < after[0] if descending else u["high"] > after[0])]
        return query.scan_batch(self.frame(name, units), ScanOrder(columns, descending), after, limit, filters, or_groups)

    # Writing
    def _write(self, name: str, df: DataFrame) -> dict | None:
        """Write a frame (_id and live columns) as one unit; None if it is empty."""
        t = self._open(name)
        columns = [c for c in t["columns"] if not c["dropped"]]
        out = df.select(ID, *(F.col(f"`{c['name']}`").cast(DataType(c["type"]).spark).alias(f"c{c['col_id']}") for c in columns))
        if t["check"]:
            body = F.to_json(F.struct(*((F.base64(f"c{c['col_id']}") if c["type"] == "blob" else F.col(f"c{c['col_id']}")).alias(f"c{c['col_id']}") for c in columns)), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
            out = out.select(ID, F.aes_encrypt(body, F.lit(self.keys[name]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(name)).alias("payload"))
        path = self.store.new_unit(name)
        out.write.parquet(self.store.path(path))
        self.store.settle_unit(path)
        low, high, rows = self.spark.read.schema(f"{ID} long").parquet(self.store.path(path)).agg(F.min(ID), F.max(ID), F.count(F.lit(1))).first()
        return {"path": path, "low": low, "high": high, "rows": rows, "col_ids": [c["col_id"] for c in columns]} if rows else None

    def _frame_of(self, name: str, ids: Sequence[int], rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        columns = self.live(name)
        data = []
        for i, r in zip(ids, rows, strict=True):
            values = [E.checked(r[c.name], c.type, c.name) if c.name in r else c.default_value for c in columns]
            if sum(map(E.size_of, values)) > self.max_row:
                raise E.RowTooLarge(f"row {i} is over {self.max_row} bytes")
            data.append((i, *values))
        return self.spark.createDataFrame(data, T.StructType([T.StructField(ID, T.LongType()), *(T.StructField(c.name, c.type.spark) for c in columns)]))

    def _check_unique(self, name: str, new: DataFrame, units: list[dict]) -> None:
        for i in self.list_indexes(name):
            for c in i["columns"][:1]:
                if isinstance(new.schema[c].dataType, T.DoubleType) and not new.where(F.isnan(c)).isEmpty():
                    raise E.TypeMismatch(f"NaN in {c}, which leads the index {i['name']}")
                if isinstance(new.schema[c].dataType, T.StringType) and not new.where(F.contains(F.col(c), F.lit("\0"))).isEmpty():
                    raise E.TypeMismatch(f"a NUL in {c}, which leads the index {i['name']}")
            if i["unique"]:
                old = self.frame(name, units)
                if not mutate.violations(new, i["columns"]).isEmpty() or (units and not mutate.conflicts(new, old, i["columns"]).isEmpty()):
                    raise E.UniqueViolation(f"index {i['name']}")

    def _append(self, name: str, new: DataFrame, next_id: int) -> None:
        t = self.table(name)
        if t["indexes"]:
            self._check_unique(name, new, t["units"])
        unit = self._write(name, new)
        if unit:
            t["units"].append(unit)
            t["rows"] += unit["rows"]
        t["next_id"] = max(t["next_id"], next_id)

    def insert(self, name: str, row: Mapping[str, Any]) -> int:
        return self.insert_many(name, [row])[0]

    def insert_with_id(self, name: str, row_id: int, row: Mapping[str, Any]) -> int:
        if not 0 <= row_id <= E.MAX_ID:
            raise E.TypeMismatch("ids are 0 to 2^63 - 1")
        if self.get(name, row_id) is not None:
            raise E.DuplicateKey(f"{name} has {row_id}")
        self._append(name, self._frame_of(name, [row_id], [row]), row_id + 1)
        return row_id

    def insert_many(self, name: str, rows: Sequence[Mapping[str, Any]]) -> list[int]:
        first = self._open(name)["next_id"]
        ids = list(range(first, first + len(rows)))
        if rows:
            self._append(name, self._frame_of(name, ids, rows), first + len(rows))
        return ids

    def insert_frame(self, name: str, rows: DataFrame, order: Sequence[Column | str]) -> int:
        """Append a frame of any size; ids follow the given order. Missing columns get their defaults."""
        first = self._open(name)["next_id"]
        have = set(rows.columns)
        rows = self._checked_frame(name, rows)
        filled = rows.select("*", *(F.lit(c.default_value).cast(c.type.spark).alias(c.name) for c in self.live(name) if c.name not in have))
        before = self.table(name)["rows"]
        self._append(name, mutate.with_ids(filled, first, order), first)
        n = self.table(name)["rows"] - before
        self.table(name)["next_id"] = max(self.table(name)["next_id"], first + n)
        return n

    def _checked_frame(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, if their columns hold the declared types (whole numbers widen, also to reals) and each fits the row size."""
        size = F.lit(0).cast("long")
        for c in self.live(name):
            if c.name not in rows.columns:
                continue
            got, want = rows.schema[c.name].dataType, c.type
            wide = isinstance(got, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            good = got == want.spark or isinstance(got, T.NullType) or (wide and want in (DataType.INTEGER, DataType.REAL)) or (isinstance(got, T.FloatType) and want is DataType.REAL) or (isinstance(got, (T.VarcharType, T.CharType)) and want is DataType.TEXT)
            if not good:
                raise E.TypeMismatch(f"{c.name} is {want.value}, not {got.simpleString()}")
            full = F.octet_length(c.name) + 5 if want in (DataType.TEXT, DataType.BLOB) else F.lit(2 if want is DataType.BOOLEAN else 9)
            size = size + F.when(F.col(f"`{c.name}`").isNull(), 1).otherwise(full)
        if any(c.type in (DataType.TEXT, DataType.BLOB) and c.name in rows.columns for c in self.live(name)):
            big = rows.agg(F.max(size)).first()[0]  # no shuffle of rows: one number a task
            if big is not None and big > self.max_row:
                raise E.RowTooLarge(f"a row has {big} bytes, over {self.max_row}")
        return rows

    def _rewrite(self, name: str, filters: Sequence[Filter], change: Callable[[DataFrame], DataFrame], patched: bool) -> int:
        """Replace units with matches; one counting job tells which."""
        t = self._open(name)
        near = self._near(name, filters)
        if not near:
            return 0
        marked = reduce(DataFrame.unionByName, [self.frame(name, [u]).withColumn("_unit", F.lit(i)) for i, u in enumerate(near)])
        p = compile_all(marked, filters)
        hits = {r[0]: r[1] for r in (marked if p is None else marked.where(p)).groupBy("_unit").count().collect()}  # one row a unit
        if not hits:
            return 0
        touched = [u for i, u in enumerate(near) if i in hits]
        rest = [u for u in t["units"] if u not in touched]
        after = change(self.frame(name, touched))
        if patched and t["indexes"]:
            self._check_unique(name, after, rest)
        unit = self._write(name, after)
        t["units"] = rest + ([unit] if unit else [])
        t["rows"] = sum(u["rows"] for u in t["units"])
        return sum(hits.values())

    def _patch(self, name: str, patch: Mapping[str, Any]) -> dict[str, Any]:
        return {c.name: E.checked(patch[c.name], c.type, c.name) for c in self.live(name) if c.name in patch}

    def update_where(self, name: str, filters: Sequence[Filter], patch: Mapping[str, Any]) -> int:
        patch = self._patch(name, patch)
        return self._rewrite(name, filters, lambda df: mutate.update_where(df, filters, patch), True)

    def update(self, name: str, row_id: int, patch: Mapping[str, Any]) -> bool:
        return self.update_where(name, [Filter.eq(ID, row_id)], patch) > 0

    def delete_where(self, name: str, filters: Sequence[Filter]) -> int:
        return self._rewrite(name, filters, lambda df: mutate.delete_where(df, filters), False)

    def delete(self, name: str, row_id: int) -> bool:
        return self.delete_where(name, [Filter.eq(ID, row_id)]) > 0

    def _keyed(self, name: str, key: Mapping[str, Any]) -> Row | None:
        if not any(i["unique"] and set(i["columns"]) == set(key) for i in self.list_indexes(name)):
            raise E.SchemaError(f"no unique index on exactly {sorted(key)}")
        return self.frame(name).where(compile_all(self.frame(name), [Filter.eq(c, v) for c, v in key.items()])).orderBy(ID).first()

    def upsert(self, name: str, key: Mapping[str, Any], values: Mapping[str, Any]) -> int:
        found = self._keyed(name, key)
        if found is None:
            return self.insert(name, {**key, **values})
        self.update(name, found[ID], values)
        return found[ID]

    def upsert_increment(self, name: str, key: Mapping[str, Any], counter: str, delta: float, values: Mapping[str, Any] | None = None) -> int:
        if isinstance(delta, bool) or not isinstance(delta, (int, float)):
            raise E.TypeMismatch("a delta is an integer or a real")
        found = self._keyed(name, key)
        if found is None:
            return self.insert(name, {**key, **(values or {}), counter: delta})
        now = found[counter] if counter in found else None
        if now is not None and (isinstance(now, bool) or not isinstance(now, (int, float))):
            raise E.TypeMismatch(f"{counter} isn't numeric")
        total = delta if now is None else now + delta
        self.update(name, found[ID], {**(values or {}), counter: wrap_int(total) if isinstance(total, int) else total})
        return found[ID]

    def upsert_increment_frame(self, name: str, calls: DataFrame, keys: Sequence[str], counter: str, delta: str, sets: Sequence[str], seq: str) -> None:
        """A batch of increments of any size, as if one by one in the order of seq. New keys get the other columns' defaults."""
        t = self._open(name)
        if not any(i["unique"] and set(i["columns"]) == set(keys) for i in self.list_indexes(name)):
            raise E.SchemaError(f"no unique index on exactly {sorted(keys)}")
        self._checked_frame(name, calls.select(*keys, *sets))
        defaults = {c.name: c.default_value for c in self.live(name) if c.name != counter}
        after = mutate.upsert_increment(self.frame(name), calls, keys, counter, delta, sets, seq, t["next_id"], defaults=defaults)
        after = settled(after)
        self._check_unique(name, after, [])
        unit = self._write(name, after)
        t["units"] = [unit] if unit else []
        t["rows"] = sum(u["rows"] for u in t["units"])
        t["next_id"] = max(t["next_id"], (unit or {"high": 0})["high"] + 1)

    def increments_once(self, source: str, batch: int, name: str, calls: DataFrame, keys: Sequence[str], counter: str, delta: str, sets: Sequence[str], seq: str) -> bool:
        """upsert_increment_frame, unless this or a later batch of the source is in the table already; the version says so."""
        done = self.manifest.setdefault("sources", {})
        if done.get(source, -1) >= batch:
            return False
        self.upsert_increment_frame(name, calls, keys, counter, delta, sets, seq)
        done[source] = batch
        return True

    def compact(self, name: str, cluster_by: Sequence[str] = ()) -> None:
        """One unit in place of many; sorted within files by the given columns, so that scans can skip row groups."""
        t = self._open(name)
        df = self.frame(name)
        unit = self._write(name, df.sortWithinPartitions(*cluster_by) if cluster_by else df)
        t["units"] = [unit] if unit else []

    # Indexes
    def create_index(self, name: str, index: str, columns: Sequence[str] | str, unique: bool = False) -> None:
        t = self._open(name)
        columns = [columns] if isinstance(columns, str) else list(columns)
        if not columns:
            raise E.SchemaError("an index needs a column")
        if any(i["name"] == index for i in t["indexes"]):
            raise E.IndexExists(index)
        entry = {"name": index, "columns": [self._column(name, c)["col_id"] for c in columns], "unique": unique}
        if unique and not mutate.violations(self.frame(name), columns).isEmpty():
            raise E.UniqueViolation(f"rows of {name} share {columns}")
        t["indexes"].append(entry)

    create_index_ex = create_index

    def drop_index(self, name: str, index: str) -> None:
        t = self.table(name)
        if not any(i["name"] == index for i in t["indexes"]):
            raise E.IndexNotFound(index)
        t["indexes"] = [i for i in t["indexes"] if i["name"] != index]

    # Encryption
    @staticmethod
    def _check_key(key: bytes) -> None:
        if len(key) != 32:
            raise E.InvalidKey("a key has 32 bytes")

    def _one(self, c: Column) -> Any:
        return self.spark.range(1).select(c).first()[0]

    def unlock(self, name: str, key: bytes) -> None:
        t = self.table(name)
        if not t["check"]:
            raise E.SchemaError(f"{name} isn't encrypted")
        self._check_key(key)
        if self._one(F.try_aes_decrypt(F.lit(base64.b64decode(t["check"])), F.lit(key), F.lit("GCM")).cast("string")) != CHECK:
            raise E.InvalidKey(f"not the key of {name}")
        self.keys[name] = key

    # Vector collections
    def _collection(self, table: str, name: str) -> dict:
        for c in self.manifest["collections"]:
            if (c["table"], c["name"]) == (table, name):
                return c
        raise E.CollectionNotFound(f"{table}/{name}")

    def create_collection(self, table: str, name: str, dimensions: int, metric: Metric = Metric.COSINE, m: int = 16, ef_construction: int = 200) -> None:
        self.table(table)
        if not 1 <= dimensions <= 4096 or not 1 <= m <= 128:
            raise E.SchemaError("1 to 4096 dimensions and an m of 1 to 128")
        if any((c["table"], c["name"]) == (table, name) for c in self.manifest["collections"]):
            raise E.CollectionExists(f"{table}/{name}")
        self.manifest["collections"].append({"table": table, "name": name, "dimensions": dimensions, "metric": metric.value, "m": m, "ef_construction": ef_construction, "units": [], "rows": 0})

    def drop_collection(self, table: str, name: str) -> None:
        self.manifest["collections"].remove(self._collection(table, name))

    def vectors(self, table: str, name: str, units: Sequence[str] | None = None) -> DataFrame:
        """All vectors, or those of some units."""
        c = self._collection(table, name)
        self._open(table)
        schema = T.StructType([T.StructField(ID, T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
        paths = [self.store.path(u) for u in (c["units"] if units is None else units)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if not self.table(table)["check"]:
            return self.spark.read.schema(schema).parquet(*paths)
        plain = F.aes_decrypt("payload", F.lit(self.keys[table]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(table))
        raw = self.spark.read.schema(f"{ID} long, payload binary").parquet(*paths)
        return raw.select(ID, F.from_json(plain.cast("string"), "v array<float>")["v"].alias("vec"))

    def _put_vectors(self, table: str, c: dict, df: DataFrame, keep: list[str], rows: int) -> None:
        path = self.store.new_unit(f"{table}/{c['name']}")
        if self.table(table)["check"]:
            body = F.to_json(F.struct(F.col("vec").alias("v")))
            df = df.select(ID, F.aes_encrypt(body, F.lit(self.keys[table]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(table)).alias("payload"))
        df.write.parquet(self.store.path(path))
        self.store.settle_unit(path)
        c["units"], c["rows"] = [*keep, path], rows
        if c.get("graph") and not set(c["graph"]["of"]) <= set(keep):
            c["graph"] = None

    def insert_vectors(self, table: str, name: str, items: Mapping[int, Sequence[float]]) -> None:
        c = self._collection(table, name)
        for v in items.values():
            if len(v) != c["dimensions"]:
                raise E.DimensionMismatch(f"{len(v)} components, not {c['dimensions']}")
        new = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in items.items()], f"{ID} long, vec array<float>")
        if not new.join(self.frame(table).select(ID), ID, "left_anti").isEmpty():
            raise E.StorageError(f"a vector's row isn't in {table}")
        if c["units"] and not new.join(self.vectors(table, name).select(ID), ID, "left_semi").isEmpty():
            raise E.VectorExists(f"{table}/{name} has a vector for a row")
        self._put_vectors(table, c, new, c["units"], c["rows"] + len(items))

    def insert_vectors_frame(self, table: str, name: str, vectors: DataFrame) -> int:
        """A frame (_id, vec) of any size; the same checks as for single vectors."""
        c = self._collection(table, name)
        new = settled(vectors.select(F.col(ID).cast("long").alias(ID), F.col("vec").cast("array<float>").alias("vec")))
        if not new.where(F.col("vec").isNull() | (F.size("vec") != c["dimensions"])).isEmpty():
            raise E.DimensionMismatch(f"a vector hasn't {c['dimensions']} components")
        if not new.join(self.frame(table).select(ID), ID, "left_anti").isEmpty():
            raise E.StorageError(f"a vector's row isn't in {table}")
        if not new.groupBy(ID).count().where("count > 1").isEmpty() or (c["units"] and not new.join(self.vectors(table, name).select(ID), ID, "left_semi").isEmpty()):
            raise E.VectorExists(f"{table}/{name} has a vector for a row")
        n = new.count()
        self._put_vectors(table, c, new, c["units"], c["rows"] + n)
        return n

    def insert_vector(self, table: str, name: str, row_id: int, values: Sequence[float]) -> None:
        self.insert_vectors(table, name, {row_id: values})

    def delete_vector(self, table: str, name: str, row_id: int) -> None:
        c, old = self._collection(table, name), self.vectors(table, name)
        if old.where(F.col(ID) == row_id).isEmpty():
            raise E.VectorNotFound(f"{table}/{name}: {row_id}")
        self._put_vectors(table, c, old.where(F.col(ID) != row_id), [], c["rows"] - 1)

    def update_vector(self, table: str, name: str, row_id: int, values: Sequence[float]) -> None:
        if len(values) != self._collection(table, name)["dimensions"]:
            raise E.DimensionMismatch(str(len(values)))
        self.delete_vector(table, name, row_id)
        self.insert_vector(table, name, row_id, values)

    def create_vector_graph(self, table: str, name: str, shard: int = ann.SHARD) -> None:
        """Graphs (m, ef_construction) over the vectors there are, for searches with ef_search.

        Vectors added later are searched exactly beside them; a delete or update drops the graphs.
        """
        c = self._collection(table, name)
        if self.table(table)["check"]:
            raise E.SchemaError("graphs aren't kept for encrypted tables")
        path = self.store.new_unit(f"{table}/{name}/graph")
        graphs = ann.build(self.vectors(table, name), c["dimensions"], Metric(c["metric"]), c["m"], c["ef_construction"], shard=shard)
        graphs.write.parquet(self.store.path(path))
        self.store.settle_unit(path)
        c["graph"] = {"unit": path, "of": list(c["units"])}

    def drop_vector_graph(self, table: str, name: str) -> None:
        self._collection(table, name)["graph"] = None

    def vector_search(self, table: str, name: str, q: Sequence[float], k: int = 10, ef_search: int | None = None, where: Filter | None = None) -> DataFrame:
        """Exact, but where ef_search is given and the collection has graphs. Rows that fail the filter, or are gone, never appear under a filter."""
        c = self._collection(table, name)
        if len(q) != c["dimensions"]:
            raise E.DimensionMismatch(f"{len(q)} components, not {c['dimensions']}")
        metric, filters, rows = Metric(c["metric"]), [where] if where else [], self.frame(table) if where else None
        if ef_search is None or not c.get("graph"):
            return vector.search(self.vectors(table, name), q, k, metric, filters, rows)
        graphs = self.spark.read.schema(ann.GRAPH).parquet(self.store.path(c["graph"]["unit"]))
        allowed = query.restrict(rows, filters).select(ID) if where else None
        near = ann.search(graphs, q, k, ef_search, metric, c["m"], allowed)
        new = [u for u in c["units"] if u not in c["graph"]["of"]]
        if new:
            near = near.unionByName(vector.search(self.vectors(table, name, new), q, k, metric, filters, rows)).orderBy("distance", ID).limit(k)
        return near

    def collection_info(self, table: str, name: str) -> dict:
        c = self._collection(table, name)
        return {"len": c["rows"], "is_empty": c["rows"] == 0, "dimensions": c["dimensions"], "metric": c["metric"], "m": c["m"], "ef_construction": c["ef_construction"]}


_READS = {"list_tables", "list_columns", "list_indexes", "frame", "find", "get", "multi_get", "count", "count_with", "scan_batch", "vectors", "vector_search", "collection_info", "unlock", "table"}
_WRITES = {
    "create_table", "drop_table", "add_column", "rename_column", "drop_column", "insert", "insert_with_id", "insert_many", "insert_frame", "update", "update_where", "delete", "delete_where",
    "upsert", "upsert_increment", "upsert_increment_frame", "increments_once", "compact", "create_index", "create_index_ex", "drop_index", "create_collection", "drop_collection", "insert_vector", "insert_vectors", "insert_vectors_frame", "update_vector", "delete_vector", "create_vector_graph", "drop_vector_graph",
}


class Transaction:
    """Stages every operation on a private snapshot. Leaving it without commit, or by an error, rolls back."""

    def __init__(self, db: Database, snapshot: Snapshot) -> None:
        self._db, self._snapshot, self._open = db, snapshot, True

    def __getattr__(self, name: str) -> Any:
        if name not in _READS | _WRITES:
            raise AttributeError(name)
        if not self._open:
            raise E.TransactionClosed(name)
        return getattr(self._snapshot, name)

    def commit(self) -> None:
        if not self._open:
            raise E.TransactionClosed("commit")
        self._open = False
        self._db._publish(self._snapshot)

    def rollback(self) -> None:
        self._open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_: object) -> None:
        self._open = False


class LightTransaction:
    """Every operation commits at once; leaving it keeps them."""

    def __init__(self, db: Database) -> None:
        self._db = db

    def __getattr__(self, name: str) -> Any:
        return getattr(self._db, name)

    def commit(self) -> None: ...

    def __enter__(self) -> LightTransaction:
        return self

    def __exit__(self, *_: object) -> None: ...


class Database:
    """A folder of versions. Single writes are atomic and retried on conflict; reads see the latest version."""

    def __init__(self, spark: SparkSession, path: str, durability: Durability = Durability.NORMAL) -> None:
        self.spark, self.store = spark, Store(spark, path, durability is Durability.IMMEDIATE)
        self._durability, self._acid, self._max_row, self._keys = durability, True, DEFAULT_MAX_ROW, {}

    # Settings
    def set_durability(self, durability: Durability) -> None:
        self._durability, self.store.sync = durability, durability is Durability.IMMEDIATE

    def durability(self) -> Durability:
        return self._durability

    def set_acid(self, on: bool) -> None:
        self._acid = on

    def is_acid(self) -> bool:
        return self._acid

    def set_max_row_size(self, n: int) -> None:
        self._max_row = n

    def max_row_size(self) -> int:
        return self._max_row

    # Versions
    def snapshot(self, version: int | None = None) -> Snapshot:
        """A pinned version; reads of it never change."""
        version = self.store.latest() if version is None else version
        return Snapshot(self.store, version, self.store.load(version), self._keys, self._max_row)

    def _staged(self) -> Snapshot:
        s = self.snapshot()
        s.manifest = copy.deepcopy(s.manifest)
        return s

    def _publish(self, s: Snapshot) -> None:
        self.store.publish(s.manifest, s.version + 1)

    def begin(self) -> Transaction | LightTransaction:
        return Transaction(self, self._staged()) if self._acid else LightTransaction(self)

    def begin_acid(self) -> Transaction:
        return Transaction(self, self._staged())

    def transaction(self, work: Callable[[Any], Any]) -> Any:
        """Run work in a light transaction: its operations commit one by one, an error keeps those done."""
        return work(LightTransaction(self))

    def __getattr__(self, name: str) -> Any:
        if name in _READS:
            return getattr(self.snapshot(), name)
        if name not in _WRITES:
            raise AttributeError(name)

        def write(*args: Any, **options: Any) -> Any:
            for left in range(9, -1, -1):
                s = self._staged()
                out = getattr(s, name)(*args, **options)
                try:
                    self._publish(s)
                    return out
                except E.TransactionConflict:
                    if not left:
                        raise

        return write

    def scan_all(self, name: str, page: int = 1000, **options: Any) -> Iterator[Batch]:
        """All pages of one version."""
        s, token = self.snapshot(), None
        while True:
            batch = s.scan_batch(name, after=token, limit=page, **options)
            yield batch
            token = batch.token
            if token is None:
                return

    def vacuum(self, keep: int = 1) -> tuple[int, int]:
        """Remove old versions and units that none of the kept ones names. Only while nothing writes or reads older versions."""
        return self.store.vacuum(max(1, keep))

    def close(self) -> None:
        """Nothing is pending after a commit."""

    def describe(self) -> str:
        return json.dumps(self.snapshot().manifest, indent=1)


def open_database(spark: SparkSession, path: str, durability: Durability = Durability.NORMAL) -> Database:
    return Database(spark, path, durability)
