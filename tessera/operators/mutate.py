"""Mutations as pure transforms of frames: each gives the state after, or the rows to add."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.counters import sum_wrapping, wrapped
from ..predicate import Filter, compile_all
from ..sources.steps import settled
from ..types import TypeMismatch


def _truth(df: DataFrame, filters: Sequence[Filter]) -> Column:
    p = compile_all(df, filters)
    return F.lit(True) if p is None else F.coalesce(p, F.lit(False))


def with_ids(rows: DataFrame, next_id: int, order: Sequence[Column | str], key: str = "_id") -> DataFrame:
    """Consecutive ids from next_id in the given order: a range sort and partition offsets, no single-task window."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = settled(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    at = at.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = at.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    first = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_o"))
    out = at.join(F.broadcast(first), "_p").withColumn(key, F.lit(next_id) + F.col("_o") + F.col("_i"))
    return out.select(key, *[c for c in rows.columns if c != key])


def update_where(df: DataFrame, filters: Sequence[Filter], patch: Mapping[str, Any]) -> DataFrame:
    """Unknown columns of the patch are ignored."""
    hit = _truth(df, filters)
    new = {c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items() if c in df.columns}
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def delete_where(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows of which the predicate isn't true, null results included."""
    return df.where(~_truth(df, filters))


def violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows; a null component exempts a row."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicts(new: DataFrame, old: DataFrame, columns: Sequence[str]) -> DataFrame:
    """New rows whose complete key an old row has."""
    for c in columns:
        new = new.where(F.col(c).isNotNull())
    return new.join(old.select(*columns), list(columns), "left_semi")


def _keyed(df: DataFrame, rows: DataFrame, keys: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """One full outer join, computed once: old rows with what matches them (o, n), and new rows without a match (n)."""
    both = df.select(F.struct(*df.columns).alias("o"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    some = rows.select(F.struct(*rows.columns).alias("n"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"a._k{i}").eqNullSafe(F.col(f"b._k{i}"))
    joined = settled(both.alias("a").join(some.alias("b"), match, "full_outer").select("o", "n"))
    return joined.where("o IS NOT NULL"), joined.where("o IS NULL").select("n.*")


def _filled(fresh: DataFrame, df: DataFrame, defaults: Mapping[str, Any], key: str) -> DataFrame:
    """New rows with all columns of df; those they lack get their defaults."""
    return fresh.select(*((F.col(c) if c in fresh.columns else F.lit(defaults.get(c))).cast(df.schema[c].dataType).alias(c) for c in df.columns))


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str], next_id: int, key: str = "_id", defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """State after inserting rows or, where their keys are there, setting their other columns. One row a key."""
    sets = [c for c in rows.columns if c not in keys]
    old, fresh = _keyed(df, rows, keys, key)
    kept = old.select(*((F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in sets else F.col(f"o.{c}")).alias(c) for c in df.columns))
    return kept.unionByName(_filled(with_ids(fresh, next_id, list(keys), key), df, defaults or {}, key))


def fold_increments(calls: DataFrame, keys: Sequence[str], delta: str, sets: Sequence[str], seq: str) -> DataFrame:
    """A batch of increments as one row a key: the total delta, the last set values, the first call."""
    kind = calls.schema[delta].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeMismatch(f"{delta} isn't numeric")
    total = sum_wrapping(F.col(delta)) if isinstance(kind, T.IntegralType) else F.sum(F.col(delta).cast("double"))
    last = [F.max_by(F.struct(F.col(c).alias(c)), seq)[c].alias(c) for c in sets]
    return calls.groupBy(*keys).agg(total.alias(delta), *last, F.min(seq).alias("_first"))


def add_counter(current: Column, delta: Column, integral: bool) -> Column:
    """Null counts as zero. Integers wrap; if either side is real the sum is real."""
    if integral:
        wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
        return wrapped(wide(current) + wide(delta))
    return F.coalesce(current.cast("double"), F.lit(0.0)) + delta.cast("double")


def upsert_increment(df: DataFrame, calls: DataFrame, keys: Sequence[str], counter: str, delta: str, sets: Sequence[str], seq: str, next_id: int, key: str = "_id", defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """State after all calls, as if one by one in the order of seq. keys are unique in df."""
    kind = df.schema[counter].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeMismatch(f"{counter} isn't numeric")
    integral = isinstance(kind, T.IntegralType)
    if integral and not isinstance(calls.schema[delta].dataType, T.IntegralType):
        raise TypeMismatch(f"{counter} is an integer column: a real delta doesn't fit")
    folded = fold_increments(calls, keys, delta, sets, seq)
    old, fresh = _keyed(df, folded, keys, key)

    def column(c: str) -> Column:
        now, met = F.col(f"o.{c}"), F.col("n").isNotNull()
        if c == counter:
            return F.when(met, add_counter(now, F.col(f"n.{delta}"), integral)).otherwise(now)
        return F.when(met, F.col(f"n.{c}")).otherwise(now) if c in sets else now

    kept = old.select(*(column(c).alias(c) for c in df.columns))
    fresh = with_ids(fresh, next_id, ["_first"], key).withColumn(counter, F.col(delta).cast(kind))
    return kept.unionByName(_filled(fresh, df, defaults or {}, key))
