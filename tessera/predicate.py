"""Filters and their compilation to one Spark Column.

Null is an ordinary value here, smaller than all others and equal to itself; values of types that don't
compare match no operator. A filter is resolved against the frame's schema first, because Spark would cast or
fail on mismatched literals, and is spelled so that it still reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import ColumnNotFound, Kind, kind_of_type, kind_of_value


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None

    @staticmethod
    def eq(column: str, value: Any) -> Filter:
        return Filter(column, "eq", value)

    @staticmethod
    def ne(column: str, value: Any) -> Filter:
        return Filter(column, "ne", value)

    @staticmethod
    def lt(column: str, value: Any) -> Filter:
        return Filter(column, "lt", value)

    @staticmethod
    def le(column: str, value: Any) -> Filter:
        return Filter(column, "le", value)

    @staticmethod
    def gt(column: str, value: Any) -> Filter:
        return Filter(column, "gt", value)

    @staticmethod
    def ge(column: str, value: Any) -> Filter:
        return Filter(column, "ge", value)

    @staticmethod
    def in_list(column: str, values: Iterable[Any]) -> Filter:
        return Filter(column, "in", tuple(values))

    @staticmethod
    def is_null(column: str) -> Filter:
        return Filter(column, "is_null")

    @staticmethod
    def is_not_null(column: str) -> Filter:
        return Filter(column, "is_not_null")


#: What an operator gives against a null literal, and against a literal of a type that doesn't compare.
_AGAINST_NULL = {"eq": "null", "ne": "some", "lt": "none", "le": "null", "gt": "some", "ge": "all"}
_AGAINST_OTHER = {"eq": "none", "ne": "null", "lt": "null", "le": "null", "gt": "none", "ge": "none"}


def _outcome(c: Column, what: str) -> Column:
    return {"null": c.isNull(), "some": c.isNotNull(), "none": F.lit(False), "all": F.lit(True)}[what]


def _compare(c: Column, kind: Kind, op: str, v: Any) -> Column:
    if v is None:
        return _outcome(c, _AGAINST_NULL[op])
    if kind_of_value(v) is not kind or kind is Kind.OTHER:
        return _outcome(c, _AGAINST_OTHER[op])
    v = F.lit(bytes(v) if isinstance(v, bytearray) else v)
    if op == "eq":
        return c == v
    if op == "ne":
        return ~c.eqNullSafe(v)
    if op == "gt":
        return c > v
    if op == "ge":
        return c >= v
    return ((c < v) if op == "lt" else (c <= v)) | c.isNull()


def compile_filter(df: DataFrame, f: Filter, strict: bool = False) -> Column:
    names = df.columns
    if f.column in names:
        c, kind = F.col(f"`{f.column}`"), kind_of_type(df.schema[f.column].dataType)
    elif strict:
        raise ColumnNotFound(f.column)
    else:
        c, kind = F.lit(None).cast("string"), Kind.OTHER  # an unknown column reads as null
    if f.op == "is_null":
        return c.isNull()
    if f.op == "is_not_null":
        return c.isNotNull()
    if f.op == "in":
        some = [v for v in f.value if v is not None and kind_of_value(v) is kind and kind is not Kind.OTHER]
        parts = [c.isin(*some)] if some else []
        if any(v is None for v in f.value):
            parts.append(c.isNull())
        return reduce(Column.__or__, parts) if parts else F.lit(False)
    return _compare(c, kind, f.op, f.value)


def compile_all(df: DataFrame, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = (), strict: bool = False) -> Column | None:
    """ALL(filters) AND (no groups OR ANY(ALL(group))); None if nothing restricts."""
    both = [compile_filter(df, f, strict) for f in filters]
    if or_groups:
        groups = [reduce(Column.__and__, [compile_filter(df, f, strict) for f in g]) if g else F.lit(True) for g in or_groups]
        both.append(reduce(Column.__or__, groups))
    return reduce(Column.__and__, both) if both else None


def restrict(df: DataFrame, filters: Sequence[Filter] = (), or_groups: Sequence[Sequence[Filter]] = (), strict: bool = False) -> DataFrame:
    p = compile_all(df, filters, or_groups, strict)
    return df if p is None else df.where(p)
