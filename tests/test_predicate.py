"""Every operator against every kind of value, held against a plain model of the comparison rules."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import Filter
from tessera.predicate import compile_all, compile_filter
from tessera.types import ColumnNotFound

VALUES = {
    "integer": (T.LongType(), [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1]),
    "real": (T.DoubleType(), [None, -1.5, -0.0, 0.0, 1.0, math.nan]),
    "text": (T.StringType(), [None, "", "Z", "z", "é", "😀"]),
    "blob": (T.BinaryType(), [None, b"", b"\x00", b"\xff"]),
    "boolean": (T.BooleanType(), [None, False, True]),
}


def kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(a, b):
    """-1, 0, 1, or None where the values don't compare."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    if kind(a) != kind(b):
        return None
    if kind(a) == "number" and (isinstance(a, float) or isinstance(b, float)):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) - math.isnan(b)
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


def matches(op, a, b):
    if op == "in":
        return any(compare(a, x) == 0 for x in b)
    c = compare(a, b)
    return c is not None and {"eq": c == 0, "ne": c != 0, "lt": c < 0, "le": c <= 0, "gt": c > 0, "ge": c >= 0}[op]


@pytest.mark.parametrize("name", VALUES)
def test_truth_table(spark, name):
    t, column = VALUES[name]
    literals = [v for _, vs in VALUES.values() for v in vs]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(column)], T.StructType([T.StructField("_id", T.LongType()), T.StructField("c", t)])).coalesce(1)
    cases = list(itertools.product(("eq", "ne", "lt", "le", "gt", "ge"), literals)) + [("in", ()), ("in", (None,)), ("in", tuple(literals)), ("in", ("z", 1, True))]
    flags = df.orderBy("_id").select(*(F.coalesce(compile_filter(df, Filter("c", op, v)), F.lit(False)).alias(str(i)) for i, (op, v) in enumerate(cases))).collect()
    for row, a in zip(flags, column, strict=True):
        for i, (op, v) in enumerate(cases):
            assert row[i] == matches(op, a, v), (op, a, v)


def test_groups_and_unknown_columns(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "_id long, c int")
    ids = lambda p: sorted(r[0] for r in (df if p is None else df.where(p)).collect())
    assert ids(compile_all(df)) == [1, 2]
    assert ids(compile_all(df, [], [[]])) == [1, 2]
    assert ids(compile_all(df, [Filter.is_not_null("c")], [[Filter.eq("c", 4)], [Filter.eq("c", 5)]])) == [1]
    assert ids(compile_all(df, [Filter.is_null("x")])) == [1, 2]
    assert ids(compile_all(df, [Filter.eq("x", 1)])) == []
    with pytest.raises(ColumnNotFound):
        compile_all(df, [Filter.eq("x", 1)], strict=True)


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    for f in (Filter.lt("o_totalprice", 5.0), Filter.ne("o_orderstatus", "F"), Filter.eq("o_custkey", 1)):
        plan = df.where(compile_filter(df, f))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
