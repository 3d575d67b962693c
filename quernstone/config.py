"""The configuration file: TOML, checked key by key."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from .errors import ConfigError
from .operators.schema import KINDS, TableSchema

_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}


@dataclass(frozen=True)
class Source:
    type: str
    path: str
    delimiter: str = ","
    gzip: bool = False
    table: str = ""
    multiline: bool = True


@dataclass(frozen=True)
class Settings:
    source: Source
    schema: TableSchema
    memory_limit: int
    chunk_size_rows: int
    worker_threads: int
    string_value_counts: bool = False
    reload_interval_mins: int = 0
    bind: str = "127.0.0.1:8080"
    partition_column: str | None = None


def byte_size(raw: int | str) -> int:
    """Bytes of a number or of a text such as "8 GiB" (units of 1024; underscores may part digits)."""
    if isinstance(raw, bool) or not isinstance(raw, (int, str)):
        raise ConfigError(f"not a byte size: {raw!r}")
    m = re.fullmatch(r"\s*([0-9_]*)\s*([^0-9_]?.*?)\s*", str(raw), re.DOTALL)
    digits, unit = m[1].replace("_", ""), m[2].lower()
    if not digits:
        raise ConfigError(f"no digits in the byte size {raw!r}")
    if unit not in _UNITS:
        raise ConfigError(f"{raw!r}: {unit!r} is no unit of bytes")
    size = int(digits) * 1024 ** _UNITS[unit]
    if size >= 1 << 64:
        raise ConfigError(f"{raw!r}: a byte size must be below 2^64")
    return size


def _table(found: dict, name: str, keys: dict[str, type | tuple], required: tuple[str, ...]) -> dict:
    part = found.get(name)
    if not isinstance(part, dict):
        raise ConfigError(f"missing section [{name}]")
    for key, value in part.items():
        if key not in keys:
            raise ConfigError(f"unknown key {name}.{key}")
        if not isinstance(value, keys[key]) or (isinstance(value, bool) and keys[key] is not bool):
            raise ConfigError(f"{name}.{key}: wrong type")
    for key in required:
        if key not in part:
            raise ConfigError(f"missing key {name}.{key}")
    return part


def _source(found: dict) -> Source:
    kind = found.get("source", {}).get("type") if isinstance(found.get("source"), dict) else None
    if kind == "csv":
        part = _table(found, "source", {"type": str, "path": str, "delimiter": str, "gzip": bool, "multiline": bool}, ("path",))
        delimiter = part.get("delimiter", ",")
        if len(delimiter) != 1 or not delimiter.isascii():
            raise ConfigError(f"source.delimiter must be one ASCII character, not {delimiter!r}")
        return Source("csv", part["path"], delimiter, part.get("gzip", False), multiline=part.get("multiline", True))
    if kind == "sqlite":
        part = _table(found, "source", {"type": str, "path": str, "table": str}, ("path", "table"))
        return Source("sqlite", part["path"], table=part["table"])
    raise ConfigError(f"source.type must be csv or sqlite, not {kind!r}")


def parse(text: str) -> Settings:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"invalid TOML: {e}") from None
    for key in found:
        if key not in ("source", "engine", "api", "searchable", "partition_column"):
            raise ConfigError(f"unknown key {key}")
    engine = _table(found, "engine", {"memory_limit": (int, str), "chunk_size_rows": int, "worker_threads": int, "string_value_counts": bool, "reload_interval_mins": int}, ("memory_limit", "chunk_size_rows", "worker_threads"))
    for key in ("chunk_size_rows", "worker_threads"):
        if engine[key] < 1:
            raise ConfigError(f"engine.{key} must be at least 1")
    if not 0 <= engine.get("reload_interval_mins", 0) < 1 << 32:
        raise ConfigError("engine.reload_interval_mins must not be negative")
    api = _table(found, "api", {"bind": str}, ("bind",))
    declared = found.get("searchable")
    if not isinstance(declared, dict) or not declared:
        raise ConfigError("no [searchable.<column>] is declared")
    visible, hidden = {}, {}
    for name in declared:
        part = _table(declared, name, {"type": str, "hidden": bool}, ("type",))
        if part["type"] not in KINDS:
            raise ConfigError(f"searchable.{name}.type must be one of {', '.join(KINDS)}")
        (hidden if part.get("hidden", False) else visible)[name] = part["type"]
    partition = found.get("partition_column")
    if partition is not None and not isinstance(partition, str):
        raise ConfigError("partition_column must be a string")
    return Settings(_source(found), TableSchema.of(visible, hidden), byte_size(engine["memory_limit"]), engine["chunk_size_rows"], engine["worker_threads"], engine.get("string_value_counts", False), engine.get("reload_interval_mins", 0), api["bind"], partition)


def load(path: str) -> Settings:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"cannot read {path}: {e}") from None
