"""Request bodies to queries: strict about keys and types, and about which of several bounds counts."""

from __future__ import annotations

import json

from ..errors import BoundError, RequestError
from ..functions import times
from ..operators.predicate import Query, Range

CLAUSES, BOUNDS = ("must", "must_not", "ranges"), ("eq", "gt", "gte", "lt", "lte")


def _no_repeats(pairs):
    out = {}
    for key, value in pairs:
        if key in out and key in (*CLAUSES, *BOUNDS):
            raise RequestError(f"duplicate field `{key}`")
        out[key] = value
    return out


def _no_constants(name: str):
    raise ValueError(f"{name} is not JSON")


def body(raw: bytes | str) -> dict:
    """The object in a request body. Broken JSON has status 400, JSON of another shape 422."""
    try:
        found = json.loads(raw, object_pairs_hook=_no_repeats, parse_constant=_no_constants)
    except (ValueError, RecursionError) as e:
        raise RequestError(f"invalid JSON: {e}", 400) from None
    if not isinstance(found, dict):
        raise RequestError("a query must be an object")
    return found


def bound(value) -> float:
    """A number, or an RFC3339 time as its seconds."""
    if isinstance(value, str):
        try:
            return float(times.to_seconds(value))
        except ValueError:
            raise BoundError(f'range bound "{value}" is not an RFC3339 date-time') from None
    return float(value)


def _shaped(value, where: str):
    if value is None or isinstance(value, str) or (isinstance(value, (int, float)) and not isinstance(value, bool)):
        return value
    raise RequestError(f"{where}: a bound must be a number or a string")


def _range(found, where: str) -> dict:
    if not isinstance(found, dict):
        raise RequestError(f"{where}: a range must be an object")
    for key in found:
        if key not in BOUNDS:
            raise RequestError(f"{where}: unknown field `{key}`")
    return {k: _shaped(v, where) for k, v in found.items()}


def _of(r: dict) -> Range:
    """eq beats all; gte beats gt and lte beats lt. A bound that loses isn't even read."""
    if r.get("eq") is not None:
        return Range.exactly(bound(r["eq"]))

    def side(closed: str, open_: str):
        if r.get(closed) is not None:
            return bound(r[closed]), True
        return (bound(r[open_]), False) if r.get(open_) is not None else None

    return Range(side("gte", "gt"), side("lte", "lt"))


def parse(found: dict | bytes | str) -> Query:
    """RequestError for a body of the wrong shape, BoundError for a bound that can't be read."""
    found = found if isinstance(found, dict) else body(found)
    for key in found:
        if key not in CLAUSES:
            raise RequestError(f"unknown field `{key}`")
    lists: dict[str, dict] = {}
    for clause in CLAUSES:
        part = found.get(clause, {})
        if not isinstance(part, dict):
            raise RequestError(f"{clause}: must be an object")
        lists[clause] = part
    for clause in CLAUSES[:2]:
        for name, values in lists[clause].items():
            if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise RequestError(f"{clause}.{name}: must be a list of strings")
    shaped = {name: [_range(r, f"ranges.{name}") for r in (rs if isinstance(rs, list) else [rs])] for name, rs in lists["ranges"].items()}
    ranges = {name: tuple(_of(r) for r in rs) for name, rs in shaped.items()}
    return Query({n: tuple(v) for n, v in lists["must"].items()}, {n: tuple(v) for n, v in lists["must_not"].items()}, ranges)
