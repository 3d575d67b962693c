"""Sources by the type that a configuration names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from . import csv, sqlite

READERS = {
    "csv": lambda spark, s: csv.scan(spark, s.source.path, s.schema, s.source.delimiter, s.source.gzip, s.source.multiline),
    "sqlite": lambda spark, s: sqlite.scan(spark, s.source.path, s.source.table, s.schema),
}


def scan(spark: SparkSession, settings: Settings) -> DataFrame:
    """A further source needs a key here and a class of settings."""
    return READERS[settings.source.type](spark, settings)
