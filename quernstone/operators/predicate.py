"""Filters: inclusion, exclusion and ranges, compiled to one column expression.

Every comparison stays in the form "column operator literal" with a literal of the column's own type, so that Parquet row groups and
cached batches can be skipped by their statistics.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import times
from .schema import DATE_TIME, FLOAT, STRING, TableSchema

_EXACT = 2.0**53
_EPOCH = dt.datetime(1970, 1, 1)
_FIRST, _LAST = (dt.datetime(1, 1, 1) - _EPOCH).total_seconds(), (dt.datetime(9999, 12, 31) - _EPOCH).total_seconds()


@dataclass(frozen=True)
class Range:
    """low and high: (bound, whether the bound itself is in). Bounds are doubles; no bound admits every value but null."""

    low: tuple[float, bool] | None = None
    high: tuple[float, bool] | None = None

    @staticmethod
    def exactly(value: float) -> Range:
        return Range((value, True), (value, True))


@dataclass(frozen=True)
class Query:
    must: dict[str, tuple[str, ...]] = field(default_factory=dict)
    must_not: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[Range, ...]] = field(default_factory=dict)


def check(query: Query, schema: TableSchema) -> None:
    """Every column exists and is of a kind that its clause can filter."""
    asked = [("must", n, True) for n in query.must] + [("must_not", n, True) for n in query.must_not] + [("ranges", n, False) for n in query.ranges]
    for clause, name, of_strings in asked:
        column = schema.get(name)
        if column is None:
            raise QueryError(f"{clause}: there is no column {name!r}")
        if (column.kind == STRING) != of_strings:
            raise QueryError(f"{clause}: {name!r} holds {column.kind} values; this clause is for {'strings' if of_strings else 'numbers and times'}")


def _whole(bound: tuple[float, bool] | None, lower: bool) -> float | None:
    """The bound as the smallest or largest whole number that satisfies it."""
    if bound is None:
        return None
    v, closed = bound
    if math.isinf(v):
        return v
    if lower:
        return math.ceil(v) if closed else math.floor(v) + 1
    return math.floor(v) if closed else math.ceil(v) - 1


def _integer(c: Column, r: Range) -> Column:
    if any(b is not None and (math.isnan(b[0]) or abs(b[0]) >= _EXACT) for b in (r.low, r.high)):
        return _plain(c.cast("double"), r)  # beyond 2^53 the comparison is one of rounded doubles
    low, high = _whole(r.low, True), _whole(r.high, False)
    parts = [c >= F.lit(int(low))] if low is not None else []
    return _all(parts + ([c <= F.lit(int(high))] if high is not None else []))


def _stamp(c: Column, r: Range, zoned: bool) -> Column:
    """On a timestamp, with a zone or without, of which only whole seconds count."""
    at = (lambda s: F.timestamp_seconds(F.lit(s))) if zoned else (lambda s: times.stamp(_EPOCH + dt.timedelta(seconds=s)))
    low, high, parts = _whole(r.low, True), _whole(r.high, False), []
    if any(b is not None and math.isnan(b) for b in (low, high)):
        return F.lit(False)
    if low is not None:
        if low > _LAST:
            return F.lit(False)
        if low > _FIRST:
            parts.append(c >= at(int(low)))
    if high is not None:
        if high < _FIRST:
            return F.lit(False)
        if high < _LAST:
            parts.append(c < at(int(high) + 1))
    return _all(parts)


def _plain(c: Column, r: Range) -> Column:
    parts = []
    if r.low is not None:
        parts.append(c >= F.lit(float(r.low[0])) if r.low[1] else c > F.lit(float(r.low[0])))
    if r.high is not None:
        parts.append(c <= F.lit(float(r.high[0])) if r.high[1] else c < F.lit(float(r.high[0])))
    if any(b is not None and math.isnan(b[0]) for b in (r.low, r.high)):
        return F.lit(False)
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def _range(name: str, kind: str, physical: T.DataType, wanted: tuple[Range, ...]) -> Column:
    c = F.col(f"`{name}`")
    if not wanted:
        return F.lit(False)
    if any(r.low is None and r.high is None for r in wanted):
        return c.isNotNull()  # NaN is in, but for null nothing is
    if kind == FLOAT:
        return c.isNotNull() & ~F.isnan(c) & _any([_plain(c, r) for r in wanted])
    if kind == DATE_TIME and isinstance(physical, (T.TimestampNTZType, T.TimestampType)):
        return c.isNotNull() & _any([_stamp(c, r, isinstance(physical, T.TimestampType)) for r in wanted])
    return c.isNotNull() & _any([_integer(c, r) for r in wanted])


def compiled(query: Query, schema: TableSchema, physical: T.StructType) -> Column | None:
    """One expression for the whole query; None when every row matches."""
    check(query, schema)
    parts = [F.col(f"`{n}`").isin(list(v)) if v else F.lit(False) for n, v in query.must.items()]
    parts += [F.col(f"`{n}`").isNull() | ~F.col(f"`{n}`").isin(list(v)) for n, v in query.must_not.items() if v]
    parts += [_range(n, schema.get(n).kind, physical[n].dataType, r) for n, r in query.ranges.items()]
    return _all(parts) if parts else None


def matching(df: DataFrame, query: Query, schema: TableSchema) -> DataFrame:
    condition = compiled(query, schema, df.schema)
    return df if condition is None else df.where(condition)
