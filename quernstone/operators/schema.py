"""Declared tables: which columns, of which kind, hidden or not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INTEGER, FLOAT, STRING, DATE_TIME = "integer", "float", "string", "date-time"
KINDS = (INTEGER, FLOAT, STRING, DATE_TIME)
_SPARK = {INTEGER: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType(), DATE_TIME: T.LongType()}


@dataclass(frozen=True)
class Column:
    """A hidden column can be filtered on, and is left out of results."""

    name: str
    kind: str
    hidden: bool = False


@dataclass(frozen=True)
class TableSchema:
    """Columns by name, in alphabetical order."""

    columns: tuple[Column, ...]

    @staticmethod
    def of(visible: dict[str, str], hidden: dict[str, str] | None = None) -> TableSchema:
        both = [Column(n, k) for n, k in visible.items()] + [Column(n, k, True) for n, k in (hidden or {}).items()]
        return TableSchema(tuple(sorted(both, key=lambda c: c.name)))

    def get(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def visible(self, *kinds: str) -> list[Column]:
        return [c for c in self.columns if not c.hidden and c.kind in kinds]

    def spark(self) -> T.StructType:
        """As stored after ingestion: date-times are whole seconds since 1970, UTC."""
        return T.StructType([T.StructField(c.name, _SPARK[c.kind], True, {"kind": c.kind, "hidden": c.hidden}) for c in self.columns])
