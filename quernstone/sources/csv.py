"""CSV files: header required, declared columns only, ragged rows refused, cells converted strictly."""

from __future__ import annotations

import csv as pycsv
import gzip as pygzip
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, IngestionError
from ..functions import coerce
from ..operators.schema import TableSchema


def _header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """The names in the first line of the (first) file, as they stand there."""
    return spark.read.option("header", "false").option("sep", delimiter).option("escape", '"').option("multiLine", "true").csv(path).limit(1).toPandas().iloc[0].tolist() if not spark.read.text(path).isEmpty() else []


def _places(header: list, schema: TableSchema) -> dict[str, int]:
    """Where each declared column stands; the first of equal names counts."""
    names = [("" if h is None else str(h)).removeprefix("﻿") if i == 0 else h for i, h in enumerate(header)]
    out = {}
    for name in schema.names:
        if name not in names:
            raise IngestionError(f'column "{name}" is missing in the header')
        out[name] = names.index(name)
    return out


def _typed(cells: DataFrame, places: dict[str, int], schema: TableSchema) -> DataFrame:
    columns = cells.columns
    return cells.select(*[coerce.strict(c.name, c.kind, F.col(f"`{columns[places[c.name]]}`")) for c in schema.columns])


def _unpacked(spark: SparkSession, path: str, gzip: bool, delimiter: str, schema: TableSchema) -> DataFrame:
    """Files whose name doesn't tell whether they are compressed: read as streams, one task a file (gzip can't be split anyway)."""
    files = spark.read.format("binaryFile").load(path).select("path")
    names = schema.names

    def rows(batches):
        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            for place in batch.column(0).to_pylist():
                system, name = pa.fs.FileSystem.from_uri(place)
                data = system.open_input_stream(name, compression=None)
                text = io.TextIOWrapper(pygzip.GzipFile(fileobj=data) if gzip else io.BufferedReader(data), encoding="utf-8", newline="")
                reader = pycsv.reader(text, delimiter=delimiter, strict=True)
                header = next(reader, [])
                places, held = _places(header, schema), []
                for row in reader:
                    if not row:
                        continue
                    if len(row) != len(header):
                        raise IngestionError(f"line {reader.line_num}: {len(row)} cells, the header has {len(header)}")
                    held.append([row[places[n]] for n in names])
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    cells = files.mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))
    return _typed(cells, {n: i for i, n in enumerate(names)}, schema)


def scan(spark: SparkSession, path: str, schema: TableSchema, delimiter: str = ",", gzip: bool = False, multiline: bool = True) -> DataFrame:
    """The declared columns of a CSV file (or folder of files with one header).

    ``gzip`` decides whether files are compressed, whatever they are called. A file with line breaks inside of cells can't be split:
    where there are none, ``multiline`` = False reads a large file in many tasks.
    """
    if len(delimiter) != 1 or not delimiter.isascii():
        raise ConfigError(f"delimiter must be one ASCII character, not {delimiter!r}")
    packed = [name.endswith(".gz") for (name,) in spark.read.format("binaryFile").load(path).select(F.col("path")).limit(1).collect()]
    if packed and packed[0] != gzip:
        return _unpacked(spark, path, gzip, delimiter, schema)
    header = _header(spark, path, delimiter)
    places = _places(header, schema)
    cells = spark.read.option("header", "true").option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", str(multiline).lower()).option("mode", "FAILFAST").option("columnPruning", "false").option("inferSchema", "false").csv(path)
    return _typed(cells, places, schema)
