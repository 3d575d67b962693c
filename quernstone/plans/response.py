"""Results as the JSON object of an answer."""

from __future__ import annotations

import math

from pyspark.sql import Row

from ..functions import times
from ..operators.schema import DATE_TIME, STRING, TableSchema


def _number(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def shaped(row: Row, values: list[Row], schema: TableSchema) -> dict:
    """row: of aggregate.summary; values: of aggregate.values. Keys in alphabetical order; what has no value is left out."""
    numeric: dict[str, dict] = {}
    for i, column in enumerate(schema.columns):
        if column.hidden or column.kind == STRING:
            continue
        entry: dict = {"count": row[f"n{i}"]}
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if column.kind == DATE_TIME:
            if entry["count"]:
                entry |= {"oldest": times.text_of(lo), "newest": times.text_of(hi)}
        else:
            entry["sum"] = _number(row[f"sum{i}"])
            if entry["count"]:
                entry |= {"min": _number(lo), "max": _number(hi)}
        numeric[column.name] = entry
    out = {"matched_rows": row["matched_rows"], "numeric": numeric}
    counts: dict[str, dict[str, int]] = {}
    for v in sorted(values, key=lambda v: (v["column_name"], v["value"])):
        counts.setdefault(v["column_name"], {})[v["value"]] = v["cnt"]
    return out | ({"string_counts": counts} if counts else {})
