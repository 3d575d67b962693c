"""SQLite tables as a PySpark data source: read-only, declared columns only, each cell converted by its own storage class."""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import IngestionError
from ..functions import coerce
from ..operators.schema import Column, TableSchema

NAME = "quernstone_sqlite"
PART_BYTES, PARTS = 64 << 20, 4096


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class Part(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[Column]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self):
        """Equal ranges of rowid, as many as the file's size asks for, however far apart ids are; one part for small files and tables without rowid."""
        parts = min(PARTS, -(-os.path.getsize(self.path) // PART_BYTES))
        with _open(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                if parts < 2 or not isinstance(low, int) or not isinstance(high, int) or high - low < parts:
                    return [Part(None, None)]
            except sqlite3.Error:
                return [Part(None, None)]
        edges = [low + (high + 1 - low) * i // parts for i in range(parts + 1)]
        return [Part(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition):
        names = ", ".join(quoted(c.name) for c in self.columns)
        where = f" WHERE rowid BETWEEN {partition.low} AND {partition.high}" if partition.low is not None else ""
        try:
            with _open(self.path) as connection:
                for row in connection.execute(f"SELECT {names} FROM {quoted(self.table)}{where}"):
                    yield tuple(self._cell(c, v) for c, v in zip(self.columns, row, strict=True))
        except sqlite3.Error as e:
            raise IngestionError(f"table {self.table!r} in {self.path}: {e}") from None

    def _cell(self, column: Column, value):
        if isinstance(value, bytes):
            raise IngestionError(f"column {column.name!r} holds a blob")
        return coerce.cell(column.name, column.kind, value)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _columns(self) -> list[Column]:
        return [Column(*c) for c in json.loads(self.options["columns"])]

    def schema(self):
        return TableSchema(tuple(self._columns())).spark()

    def reader(self, schema):
        return Reader(self.options["path"], self.options["table"], self._columns())


def scan(spark: SparkSession, path: str, table: str, schema: TableSchema) -> DataFrame:
    """The declared columns of a table. Missing tables and columns are ingestion errors at once; blobs and text that isn't UTF-8, when they are read."""
    try:
        with _open(path) as c:
            names = [r[1] for r in c.execute(f"PRAGMA table_info({quoted(table)})")]
            if not names:
                raise IngestionError(f"no such table: {table!r}")
            for column in schema.columns:
                if column.name not in names:
                    raise IngestionError(f'table {table!r} has no column "{column.name}"')
    except sqlite3.Error as e:
        raise IngestionError(f"cannot read {path}: {e}") from None
    spark.dataSource.register(SqliteSource)
    columns = json.dumps([[c.name, c.kind, c.hidden] for c in schema.columns])
    return spark.read.format(NAME).option("path", path).option("table", table).option("columns", columns).load()
