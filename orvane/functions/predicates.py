"""Metadata predicates: Eq, In, Range, And, Or, Not, compiled to a Column.

Two-valued: a leaf on an absent field, or on a value of another domain, is
false, so its negation is true.  A missing value (a null in a column that the
row has) equals only ``None``.  NaN equals NaN; -0.0 differs from 0.0 in
equality but lies in ranges that hold zero.  Domains are told apart when the
tree is compiled, never by Spark's coercions.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MAX_NODES, MAX_VALUES = 64, 4096, 4096


def _domain(value: Any) -> str:
    if value is None:
        return "missing"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dt.datetime):
        return "datetime"
    if isinstance(value, dt.date):
        return "date"
    raise TypeError(f"{type(value).__name__} cannot be filtered")


def _column_domain(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.DateType):
        return "date"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "other"


class Filter:
    """A node of a predicate tree; hashable, equal by structure."""

    def column(self, schema: T.StructType, settle: bool = True) -> Column:
        raise NotImplementedError

    def children(self) -> tuple[Filter, ...]:
        return ()


def _settled(test: Column, settle: bool) -> Column:
    """A test that is false where it is null; without ``settle`` left as it is, so that a scan can take it over."""
    return F.coalesce(test, F.lit(False)) if settle else test


def _equals(schema: T.StructType, field: str, value: Any, settle: bool = True) -> Column:
    if field not in schema.names:
        return F.lit(False)
    col, have, want = F.col(f"`{field}`"), _column_domain(schema[field].dataType), _domain(value)
    if want == "missing":
        return col.isNull()
    if have == "bool" and want == "number":  # true equals 1 and false equals 0
        if value not in (0, 1):
            return F.lit(False)
        value, want = bool(value), "bool"
    elif have == "number" and want == "bool":
        value, want = int(value), "number"
    if have != want:
        return F.lit(False)
    same = col == F.lit(value)
    if want == "number" and value == 0:
        fractional = isinstance(schema[field].dataType, T.FractionalType)
        minus = isinstance(value, float) and math.copysign(1, value) < 0
        if fractional and not isinstance(schema[field].dataType, T.DecimalType):
            sign = col.cast("double").cast("string") == F.lit("-0.0")
            same = same & (sign if minus else ~sign)
        elif minus:
            return F.lit(False)
    return _settled(same, settle)


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: Any

    def __post_init__(self):
        _domain(self.value)

    def column(self, schema, settle=True):
        return _equals(schema, self.field, self.value, settle)


def _identity(value: Any) -> tuple:
    if isinstance(value, float) and math.isnan(value):
        return ("number", "nan")
    zero = isinstance(value, float) and value == 0 and math.copysign(1, value) < 0
    return (_domain(value), "-0" if zero else value)


@dataclass(frozen=True, init=False)
class In(Filter):
    field: str
    values: tuple

    def __init__(self, field: str, values: Iterable):
        if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
            raise TypeError("values must be a collection, not a string")
        found: dict = {}
        for v in values:
            found.setdefault(_identity(v), v)
        if len(found) > MAX_VALUES:
            raise ValueError(f"more than {MAX_VALUES} values")
        object.__setattr__(self, "field", field)
        object.__setattr__(self, "values", tuple(found.values()))

    def column(self, schema, settle=True):
        if self.field not in schema.names or not self.values:
            return F.lit(False)
        have = _column_domain(schema[self.field].dataType)
        plain = [v for v in self.values if v is not None and _domain(v) == have and v != 0 and v == v]
        rest = [v for v in self.values if not any(v is p for p in plain)]
        parts = [_settled(F.col(f"`{self.field}`").isin(plain), settle)] if plain else []
        return reduce(lambda a, b: a | b, parts + [_equals(schema, self.field, v, settle) for v in rest])


@dataclass(frozen=True)
class Range(Filter):
    field: str
    low: Any
    high: Any

    def __post_init__(self):
        low, high = _domain(self.low), _domain(self.high)
        if low != high or low not in ("number", "date", "datetime"):
            raise ValueError("bounds must both be numbers, dates or datetimes")
        if self.low != self.low or self.high != self.high or self.low > self.high:
            raise ValueError("bounds must be ordered")

    def column(self, schema, settle=True):
        if self.field not in schema.names or _column_domain(schema[self.field].dataType) != _domain(self.low):
            return F.lit(False)
        col = F.col(f"`{self.field}`")
        inside = col.between(F.lit(self.low), F.lit(self.high))
        if isinstance(schema[self.field].dataType, (T.FloatType, T.DoubleType)):
            inside = inside & ~F.isnan(col)
        return _settled(inside, settle)


@dataclass(frozen=True, init=False)
class And(Filter):
    parts: tuple

    def __init__(self, *parts: Filter):
        object.__setattr__(self, "parts", parts)

    def children(self):
        return self.parts

    def column(self, schema, settle=True):
        return reduce(lambda a, b: a & b, (p.column(schema, settle) for p in self.parts), F.lit(True))


@dataclass(frozen=True, init=False)
class Or(Filter):
    parts: tuple

    def __init__(self, *parts: Filter):
        object.__setattr__(self, "parts", parts)

    def children(self):
        return self.parts

    def column(self, schema, settle=True):
        return reduce(lambda a, b: a | b, (p.column(schema, settle) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def children(self):
        return (self.part,)

    def column(self, schema, settle=True):
        return ~self.part.column(schema)


def normalized(filter_: Filter | Mapping | None) -> Filter | None:
    """A mapping is a conjunction of equalities; depth and number of nodes are bounded."""
    if filter_ is None:
        return None
    if isinstance(filter_, Mapping):
        filter_ = And(*(Eq(k, v) for k, v in filter_.items()))
    if not isinstance(filter_, Filter):
        raise TypeError("a filter or a mapping is wanted")
    level, depth, nodes = [filter_], 0, 0
    while level:
        depth, nodes = depth + 1, nodes + len(level)
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise ValueError(f"a filter has at most {MAX_DEPTH} levels and {MAX_NODES} nodes")
        if not all(isinstance(x, Filter) for x in level):
            raise TypeError("parts of a filter must be filters")
        level = [c for x in level for c in x.children()]
    return filter_


def compiled(filter_: Filter | Mapping | None, schema: T.StructType, settle: bool = True) -> Column:
    """The filter as a column.

    Without ``settle`` it may be null where it is not true, which ``where``
    takes for false, and its comparisons reach the scan; what stands under a
    ``Not`` is settled all the same.
    """
    found = normalized(filter_)
    return F.lit(True) if found is None else found.column(schema, settle)


def selectivity(df: DataFrame, filter_) -> DataFrame:
    """(matches, total, selectivity) of a filter; 0 for no rows."""
    hit = compiled(filter_, df.schema)
    return df.agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("total")).withColumn("selectivity", F.when(F.col("total") > 0, F.col("matches") / F.col("total")).otherwise(0.0))


def value_postings(df: DataFrame, field: str) -> DataFrame:
    """How many rows hold each value of a field, and whether a bitmap is smaller than their positions."""
    n = df.count()
    return df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("dense", F.lit(-(-n // 8)) <= 8 * F.col("n"))
