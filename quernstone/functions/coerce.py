"""Strict conversion of source cells: what isn't exactly of the declared kind is an error that names the column."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IngestionError
from ..operators.schema import DATE_TIME, FLOAT, INTEGER, STRING
from . import times

_BLANK = r"^(?U)\s+|(?U)\s+$"
_FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
_INT = r"^[+-]?[0-9]+$"
EXPECTED = {INTEGER: "integer", FLOAT: "float", STRING: "string", DATE_TIME: "RFC3339 date-time"}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def parsed(c: Column, kind: str) -> Column:
    """A non-blank text cell as its kind, or null if it isn't of it."""
    t = trimmed(c)
    if kind == INTEGER:
        return F.when(t.rlike(_INT), t).try_cast("bigint")
    if kind == FLOAT:
        low = F.lower(F.regexp_replace(t, r"^[+-]", ""))
        sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
        special = F.when(low.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(low == "nan", F.lit(float("nan")))
        return F.when(t.rlike(_FLOAT), F.coalesce(special, t.try_cast("double")))
    if kind == DATE_TIME:
        return times.seconds_column(t)
    return c


def strict(name: str, kind: str, c: Column | None = None) -> Column:
    """A text column as its kind: null where null or blank, an error at the first other cell."""
    c = F.col(f"`{name}`") if c is None else c
    blank = c.isNull() | (trimmed(c) == "")
    if kind == STRING:
        return F.when(~blank, c).alias(name)
    value = parsed(c, kind)
    failed = F.raise_error(F.concat(F.lit(f'column "{name}": expected {EXPECTED[kind]}, got "'), c, F.lit('"')))
    return F.when(blank, F.lit(None)).otherwise(F.coalesce(value, failed.cast({INTEGER: "bigint", FLOAT: "double", DATE_TIME: "bigint"}[kind]))).alias(name)


def cell(name: str, kind: str, value):
    """The same for one typed cell (int, float, str or None), as dynamic sources give them."""

    def bad():
        return IngestionError(f'column "{name}": expected {EXPECTED[kind]}, got {value!r}')

    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if kind == STRING:
        if isinstance(value, str):
            return value
        raise bad()
    if isinstance(value, str):
        text = value.strip()
        try:
            if kind == INTEGER and re.match(_INT, text) and -(1 << 63) <= int(text) < 1 << 63:
                return int(text)
            if kind == FLOAT and re.match(_FLOAT, text):
                return float(text)
            if kind == DATE_TIME:
                return times.to_seconds(text)
        except ValueError:
            pass
        raise bad()
    if isinstance(value, int):
        return float(value) if kind == FLOAT else value
    if isinstance(value, float):
        if kind == FLOAT:
            return value
        if kind == INTEGER and math.isfinite(value) and value == int(value):
            return max(-(1 << 63), min((1 << 63) - 1, int(value)))
    raise bad()
