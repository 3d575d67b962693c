"""Order by one column, and the least and largest key of each zone of consecutive rows.

A null key counts as 0. Zones need no global numbering of rows: how many rows each key has, and a running total over keys (first in each of some
stretches between approximate quantiles of the keys, then over the stretches), say in which zones a key lies. A key that a third of the rows share is one row here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions import times
from .predicate import Range
from .schema import STRING, TableSchema

STRETCHES = 256


def ordered(df: DataFrame, schema: TableSchema, column: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of the column and sorted in each part, equal keys in the order of the source, so that statistics of batches and row groups are narrow."""
    found = schema.get(column)
    if found is None:
        raise ConfigError(f'partition column "{column}" is not declared')
    if found.kind == STRING:
        raise ConfigError(f'partition column "{column}" is string, expected numeric or date-time')
    place = "place"
    while place in df.columns:
        place += "_"
    key = [F.coalesce(F.col(f"`{column}`"), _zero(df.schema[column].dataType)), F.col(place)]
    numbered = df.withColumn(place, F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *key) if parts else numbered.repartitionByRange(*key)
    return dealt.sortWithinPartitions(*key).drop(place)


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    return times.stamp(dt.datetime(1970, 1, 1)) if isinstance(kind, T.TimestampNTZType) else F.lit(0).cast(kind)


def zones(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """zone, zone_min, zone_max of each ``rows`` consecutive rows in order of the key."""
    per_key = df.select(F.coalesce(key, F.lit(0)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cuts = per_key.agg(F.percentile_approx("key", [i / STRETCHES for i in range(1, STRETCHES)]).alias("cuts"))
    dealt = per_key.join(F.broadcast(cuts)).select("key", "n", F.size(F.filter("cuts", lambda c: c < F.col("key"))).alias("stretch"))  # one row is broadcast
    before = dealt.groupBy("stretch").agg(F.sum("n").alias("m")).select("stretch", F.coalesce(F.sum("m").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum("n").over(W.partitionBy("stretch").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    placed = dealt.withColumn("run", run).join(before, "stretch")
    first, last = F.col("base") + F.col("run") - F.col("n"), F.col("base") + F.col("run") - 1
    spread = placed.select("key", F.explode(F.sequence(F.floor(first / rows), F.floor(last / rows))).alias("zone"))
    return spread.groupBy("zone").agg(F.min("key").alias("zone_min"), F.max("key").alias("zone_max"))


def overlapping(table: DataFrame, wanted: tuple[Range, ...]) -> DataFrame:
    """The zones that one of the ranges touches."""
    lo, hi, any_ = F.col("zone_min").cast("double"), F.col("zone_max").cast("double"), F.lit(False)
    for r in wanted:
        one = F.lit(True)
        if r.low is not None:
            one = one & (hi >= F.lit(r.low[0]) if r.low[1] else hi > F.lit(r.low[0]))
        if r.high is not None:
            one = one & (lo <= F.lit(r.high[0]) if r.high[1] else lo < F.lit(r.high[0]))
        any_ = any_ | one
    return table.where(any_)
