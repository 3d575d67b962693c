"""The one global aggregate: rows, numbers, times and, on demand, counts by value.

All numbers of a query come from one partial and one final aggregation; only visible columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times
from .schema import DATE_TIME, FLOAT, INTEGER, STRING, TableSchema


def _extreme(df: DataFrame, name: str, by) -> Column:
    """Seconds of the least or largest time: the floor of the extreme is the extreme of the floors."""
    kind, found = df.schema[name].dataType, by(F.col(f"`{name}`"))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return times.of_stamp(found, isinstance(kind, T.TimestampType))
    return found


def summary(df: DataFrame, schema: TableSchema) -> DataFrame:
    """One row: matched_rows, and for each visible column its count with sum, min and max or with oldest and newest (seconds)."""
    out = [F.count(F.lit(1)).alias("matched_rows")]
    for i, column in enumerate(schema.columns):
        if column.hidden or column.kind == STRING:
            continue
        c = F.col(f"`{column.name}`")
        out.append(F.count(c).alias(f"n{i}"))
        if column.kind == DATE_TIME:
            out += [_extreme(df, column.name, F.min).alias(f"lo{i}"), _extreme(df, column.name, F.max).alias(f"hi{i}")]
        else:
            number = F.when(~F.isnan(c), c) if column.kind == FLOAT else c
            total = F.sum(c.cast("double"))
            out += [F.coalesce(total, F.lit(0.0)).alias(f"sum{i}"), F.min(number).cast("double").alias(f"lo{i}"), F.max(number).cast("double").alias(f"hi{i}")]
    return df.agg(*out)


def _stacked(row: DataFrame, entries: list[list[Column]], names: list[str]) -> DataFrame:
    made = F.array(*[F.struct(*[c.alias(n) for c, n in zip(e, names, strict=True)]) for e in entries])
    return row.select(F.explode(made).alias("r")).select("r.*")


def stats(df: DataFrame, schema: TableSchema, digits: int | None = None) -> DataFrame:
    """column_name, cnt, sum_v, min_v, max_v for each visible numeric column; digits: to which sums are rounded."""
    row, entries = summary(df, schema), []
    for i, column in enumerate(schema.columns):
        if not column.hidden and column.kind in (INTEGER, FLOAT):
            total = F.col(f"sum{i}") if digits is None else F.round(f"sum{i}", digits)
            entries.append([F.lit(column.name), F.col(f"n{i}"), total, F.col(f"lo{i}"), F.col(f"hi{i}")])
    return _stacked(row, entries, ["column_name", "cnt", "sum_v", "min_v", "max_v"])


def times_of(df: DataFrame, schema: TableSchema) -> DataFrame:
    """column_name, cnt, oldest, newest for each visible date-time column."""
    row = summary(df, schema)
    entries = [[F.lit(c.name), F.col(f"n{i}"), times.formatted(F.col(f"lo{i}")), times.formatted(F.col(f"hi{i}"))] for i, c in enumerate(schema.columns) if not c.hidden and c.kind == DATE_TIME]
    return _stacked(row, entries, ["column_name", "cnt", "oldest", "newest"])


def hits(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("matched_rows"))


def values(df: DataFrame, schema: TableSchema) -> DataFrame:
    """column_name, value, cnt of each visible string column; nulls aren't counted. One scan, summed in each task first."""
    names = [c.name for c in schema.visible(STRING)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, cnt long")
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("value")) for n in names])
    return df.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("cnt"))


def dictionary(df: DataFrame, schema: TableSchema) -> DataFrame:
    """column_name, cardinality and non_null of each visible string column."""
    by_value = values(df, schema)
    return by_value.groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"), F.sum("cnt").alias("non_null"))
