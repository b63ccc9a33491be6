"""find, count, get and ordered cursors over any frame with an integer key column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..predicate import Filter, compile_all, restrict
from ..types import IndexNotFound


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False

    @staticmethod
    def asc(column: str) -> Sort:
        return Sort(column)

    @staticmethod
    def desc(column: str) -> Sort:
        return Sort(column, True)


@dataclass
class FindOptions:
    filters: Sequence[Filter] = ()
    or_groups: Sequence[Sequence[Filter]] = ()
    sort: Sequence[Sort] = ()
    limit: int | None = None
    offset: int = 0
    include_total: bool = False
    columns: Sequence[str] | None = None
    ordered: bool = True  # False: rows in any order, where neither sort, offset nor limit is given


@dataclass
class FindResult:
    rows: DataFrame
    total: int | None = None


def order_of(df: DataFrame, sort: Sequence[Sort], key: str = "_id") -> list[Column]:
    """Null is least; sorting is stable over the ascending key, under descending columns too."""
    known = [s for s in sort if s.column in df.columns]
    return [F.col(s.column).desc_nulls_last() if s.descending else F.col(s.column).asc_nulls_first() for s in known] + [F.col(key).asc()]


def find(df: DataFrame, options: FindOptions | None = None, key: str = "_id", strict: bool = False) -> FindResult:
    """Filter, stable sort, offset, limit; the total is that of matches before pagination."""
    o = options or FindOptions()
    found = restrict(df, o.filters, o.or_groups, strict)
    total = found.count() if o.include_total else None
    plain = not o.ordered and not o.sort and not o.offset and o.limit is None
    rows = found if plain else found.orderBy(*order_of(df, o.sort, key))
    if o.offset:
        rows = rows.offset(o.offset)
    if o.limit is not None:
        rows = rows.limit(o.limit)
    return FindResult(rows.select(*o.columns) if o.columns is not None else rows, total)


def count(df: DataFrame, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = ()) -> int:
    return restrict(df, filters, or_groups).count()


def count_frame(df: DataFrame, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = ()) -> DataFrame:
    """The count as a frame of one row: a partial count in each task and one final sum."""
    return restrict(df, filters, or_groups).agg(F.count(F.lit(1)).alias("n"))


def get(df: DataFrame, row_id: int, key: str = "_id") -> Row | None:
    return df.where(F.col(key) == row_id).first()


def multi_get(df: DataFrame, ids: Sequence[int], key: str = "_id") -> DataFrame:
    return df.where(F.col(key).isin(*ids) if ids else F.lit(False)).orderBy(key)


@dataclass(frozen=True)
class ScanOrder:
    """By the key, or by an index: its columns, then the key. Descending reverses all of it."""

    columns: tuple[str, ...] = ()
    descending: bool = False


@dataclass
class Batch:
    rows: list[Row]
    token: tuple | None = None


def after(columns: Sequence[str], token: Sequence[Any], descending: bool) -> Column:
    """Lexicographically behind the token."""
    steps = []
    for i, c in enumerate(columns):
        beyond = F.col(c) < F.lit(token[i]) if descending else F.col(c) > F.lit(token[i])
        steps.append(reduce(Column.__and__, [F.col(columns[j]) == F.lit(token[j]) for j in range(i)] + [beyond]))
    return reduce(Column.__or__, steps)


def scan_page(df: DataFrame, order: ScanOrder, token: Sequence[Any] | None, limit: int, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = (), key: str = "_id") -> DataFrame:
    """The page behind the token, and one more row to tell whether another page follows."""
    columns = [*order.columns, key]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise IndexNotFound(", ".join(missing))
    p = compile_all(df, filters, or_groups)
    df = df if p is None else df.where(p)
    for c in order.columns:  # a row with a null in the index isn't in it
        df = df.where(F.col(c).isNotNull())
    if token is not None:
        df = df.where(after(columns, token, order.descending))
    return df.orderBy(*(F.col(c).desc() if order.descending else F.col(c).asc() for c in columns)).limit(limit + 1)


def scan_batch(df: DataFrame, order: ScanOrder | None = None, token: Sequence[Any] | None = None, limit: int = 1000, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = (), key: str = "_id") -> Batch:
    """At most `limit` rows; the token is None on the last page, so no empty page follows a full one."""
    order = order or ScanOrder()
    rows = scan_page(df, order, token, limit, filters, or_groups, key).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return Batch(rows, tuple(rows[-1][c] for c in (*order.columns, key)) if more and rows else None)


def scan_all(df: DataFrame, order: ScanOrder | None = None, page: int = 1000, filters: Sequence[Filter] = (), key: str = "_id") -> Iterator[Batch]:
    token = None
    while True:
        batch = scan_batch(df, order, token, page, filters, key=key)
        yield batch
        token = batch.token
        if token is None:
            return
