"""What surrounds a query, as rows that SQL can state too: byte sizes, statuses of requests, blank cells, configurations, counters, answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .. import config
from ..engine import http_status
from ..errors import ConfigError
from ..functions import coerce
from ..operators import aggregate, predicate
from ..operators.schema import DATE_TIME, FLOAT, INTEGER, KINDS, STRING, TableSchema
from ..streaming.counters import Counters
from . import request, response

#: (text, bytes, or None where it must be refused)
SIZES = [("0", 0), ("900", 900), ("3 kb", 3072), ("5K", 5120), ("2_000 KiB", 2_048_000), ("6m", 6291456), ("1GB", 1 << 30), ("3tib", 3 << 40), ("KB", None), ("4 acres", None), ("2.5M", None), ("-3", None), ("20000000T", None)]

#: (body, status of the answer) on a table of a float x, an integer n, a string s and a date-time t
BODIES = [
    ("{}", 200), ('{"must": {"s": []}}', 200), ('{"ranges": {"t": {"lt": "2001-02-03T04:05:06Z"}}}', 200), ('{"ranges": {"n": [{}, {"eq": 4}]}}', 200), ('{"ranges": {"x": {"eq": 1, "lt": "soon"}}}', 200),
    ("", 400), ("{]", 400), ('{"ranges": {"x": {"lt": Infinity}}}', 400), ('{"must": {"q": ["a"]}}', 400), ('{"must": {"x": ["1"]}}', 400), ('{"must_not": {"t": ["a"]}}', 400), ('{"ranges": {"s": {}}}', 400), ('{"ranges": {"q": {}}}', 400), ('{"ranges": {"t": {"lt": "soon"}}}', 400),
    ("7", 422), ("null", 422), ('{"limit": 3}', 422), ('{"must": []}', 422), ('{"must": {"s": "a"}}', 422), ('{"must": {"s": [null]}}', 422), ('{"must": {}, "must": {}}', 422), ('{"ranges": {"x": {"not": 1}}}', 422), ('{"ranges": {"x": {"lt": [1]}}}', 422), ('{"ranges": {"x": 1}}', 422),
]
_SMALL = TableSchema.of({"x": FLOAT, "n": INTEGER, "s": STRING, "t": DATE_TIME})

_CONFIG = '[source]\ntype = "csv"\npath = "p"\n[engine]\nmemory_limit = "1K"\nchunk_size_rows = 1\nworker_threads = 1\n[api]\nbind = "h:1"\n[searchable.x]\ntype = "float"\n'
#: (what replaces what in a good configuration, whether it is taken)
CONFIGS = [
    ("", "", True), ("[source]", 'partition_column = "x"\n[source]', True), ('"p"', '"p"\ndelimiter = ";"\ngzip = true', True), ('"float"', '"float"\nhidden = true', True), ("worker_threads = 1", "worker_threads = 1\nreload_interval_mins = 5", True),
    ('"csv"', '"orc"', False), ('path = "p"\n', "", False), ('"1K"', '"K"', False), ("chunk_size_rows = 1", "chunk_size_rows = 0", False), ("worker_threads = 1", 'worker_threads = "1"', False), ('"float"', '"decimal"', False), ("[source]", "further = 1\n[source]", False), ('"p"', '"p"\ndelimiter = "ab"', False), ('[searchable.x]\ntype = "float"\n', "", False), ('"csv"', '"sqlite"', False), ("[api]", "[api", False),
]

#: (kind, cell): all are null, whatever the kind
BLANKS = [(kind, cell) for kind in KINDS for cell in (None, "", " ", "\t \n", "　")]

#: (second, whether it was an error), and what is counted at the last second
REQUESTS = [(5, False), (5, True), (900, False), (80_000, True), (86_405, False), (89_990, False), (89_999, True), (90_000, False), (90_000, False)]


def byte_sizes(spark: SparkSession, _: str) -> DataFrame:
    def size(text: str) -> int | None:
        try:
            return config.byte_size(text)
        except ConfigError:
            return None

    return spark.createDataFrame([(t, size(t)) for t, _ in SIZES], "raw string, bytes long")


def statuses(spark: SparkSession, _: str) -> DataFrame:
    def status(body: str) -> int:
        try:
            predicate.check(request.parse(body), _SMALL)
        except Exception as e:
            return http_status(e)
        return 200

    return spark.createDataFrame([(b, status(b)) for b, _ in BODIES], "body string, status int")


def configurations(spark: SparkSession, _: str) -> DataFrame:
    def taken(a: str, b: str) -> bool:
        try:
            config.parse(_CONFIG.replace(a, b, 1) if a else _CONFIG)
        except ConfigError:
            return False
        return True

    return spark.createDataFrame([(i, taken(a, b)) for i, (a, b, _) in enumerate(CONFIGS)], "n int, taken boolean")


def blank_cells(spark: SparkSession, _: str) -> DataFrame:
    """Each cell by the strict conversion of its column's kind, which raises an error at anything else that isn't of it."""
    cells = spark.createDataFrame([(i, c, *(c if k == kind else None for kind in KINDS)) for i, (k, c) in enumerate(BLANKS)], "n int, cell string, " + ", ".join(f"`{k}` string" for k in KINDS))
    kept = cells.select("n", *[coerce.strict(k, k) for k in KINDS])
    return kept.selectExpr("n", "coalesce(" + ", ".join(f"cast(`{k}` as string)" for k in KINDS) + ") is null as blank")


def counted(spark: SparkSession, _: str) -> DataFrame:
    now = [0.0]
    counters = Counters(lambda: now[0])
    for second, error in REQUESTS:
        now[0] = float(second)
        counters.record(error)
    found = counters.snapshot()
    return spark.createDataFrame([(kind, span, n) for kind in ("queries", "errors") for span, n in found[kind].items()], "kind string, span string, n long")


ANSWER = {"must": {"l_returnflag": ["R", "A"]}, "ranges": {"l_quantity": {"gte": 3, "lt": 40}}}


def answer(df: DataFrame, schema: TableSchema) -> DataFrame:
    """The JSON object of an answer, one row for each number or text in it."""
    chosen = predicate.matching(df, request.parse(json.dumps(ANSWER)), schema)
    found = response.shaped(aggregate.summary(chosen, schema).first(), aggregate.values(chosen, schema).collect(), schema)
    rows: list[tuple[str, str]] = []

    def walk(path: str, value) -> None:
        if isinstance(value, dict):
            for key, inner in value.items():
                walk(f"{path}.{key}" if path else key, inner)
        elif not path.endswith(".sum"):  # the order of additions isn't fixed
            rows.append((path, str(int(round(value * 10_000))) if isinstance(value, float) else str(value)))

    walk("", json.loads(json.dumps(found)))
    return df.sparkSession.createDataFrame(rows, "path string, value string")


def _values(rows: list[tuple], columns: str) -> str:
    def text(x) -> str:
        if x is None:
            return "null"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) as t({columns})"


def answer_sql(schema: TableSchema, where: str) -> str:
    number = lambda x: f"round({x} * 10000)::bigint::varchar"
    time = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    parts = [f"select 'matched_rows' as path, count(*)::varchar as value from lineitem where {where}"]
    for c in schema.visible(INTEGER, FLOAT):
        parts += [f"select 'numeric.{c.name}.{key}', {sql} from lineitem where {where}" for key, sql in (("count", f"count({c.name})::varchar"), ("min", number(f"min({c.name})")), ("max", number(f"max({c.name})")))]
    for c in schema.visible(DATE_TIME):
        parts += [f"select 'numeric.{c.name}.{key}', {sql} from lineitem where {where}" for key, sql in (("count", f"count({c.name})::varchar"), ("oldest", time(f"min({c.name})")), ("newest", time(f"max({c.name})")))]
    parts += [f"select 'string_counts.{c.name}.' || {c.name}, count(*)::varchar from lineitem where {where} and {c.name} is not null group by {c.name}" for c in schema.visible(STRING)]
    return " union all ".join(parts)


def queries() -> dict:
    return {"q50_byte_sizes": byte_sizes, "q51_request_statuses": statuses, "q52_blank_cells": blank_cells, "q53_configurations": configurations, "q54_sliding_counters": counted}


def oracle_sql() -> dict[str, str]:
    now = REQUESTS[-1][0]
    spans = (("last_1m", 60), ("last_1h", 3600), ("last_24h", 86400))
    requests = _values([(s, e) for s, e in REQUESTS], "s, e")
    return {
        "q50_byte_sizes": f"select raw::varchar as raw, bytes::bigint as bytes from ({_values(SIZES, 'raw, bytes')})",
        "q51_request_statuses": f"select body, status::integer as status from ({_values(BODIES, 'body, status')})",
        "q52_blank_cells": f"select i::integer as n, true as blank from range({len(BLANKS)}) as t(i)",
        "q53_configurations": f"select n::integer as n, taken from ({_values([(i, t) for i, (_, _, t) in enumerate(CONFIGS)], 'n, taken')})",
        "q54_sliding_counters": " union all ".join(f"select '{kind}' as kind, '{name}' as span, count(*)::bigint as n from ({requests}) where {now} - s < {span}{more}" for kind, more in (("queries", ""), ("errors", " and e")) for name, span in spans),
    }
