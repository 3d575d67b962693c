"""Queries over the test tables, one or more for each operator and rule, and the SQL that must give the same rows.

Requests go the way that a client's go: a body is parsed, checked against a schema and compiled. Sums are rounded to four
digits on both sides, since the order of additions isn't fixed.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, times
from ..operators import aggregate, predicate, zones
from ..operators.predicate import Range
from ..operators.schema import DATE_TIME, FLOAT, INTEGER, STRING, TableSchema
from .. import config
from ..sources import csv, select, sqlite
from . import control, request

LINEITEM = TableSchema.of(
    {"l_quantity": FLOAT, "l_extendedprice": FLOAT, "l_discount": FLOAT, "l_tax": FLOAT, "l_linenumber": INTEGER, "l_returnflag": STRING, "l_linestatus": STRING, "l_shipdate": DATE_TIME},
    {"l_orderkey": INTEGER, "l_partkey": INTEGER, "l_suppkey": INTEGER},
)
EVENTS = TableSchema.of({"value": FLOAT, "event_type": STRING, "ts": DATE_TIME}, {"user_id": INTEGER, "event_id": INTEGER})
ORDERS = TableSchema.of({"o_totalprice": FLOAT, "o_orderstatus": STRING, "o_orderpriority": STRING, "o_orderdate": DATE_TIME, "o_custkey": INTEGER}, {"o_orderkey": INTEGER})
SCHEMAS = {"lineitem": LINEITEM, "events": EVENTS, "orders": ORDERS}
DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def selected(df: DataFrame, schema: TableSchema, body: dict) -> DataFrame:
    return predicate.matching(df, request.parse(body), schema)


def _stats(df, schema):
    return aggregate.stats(df, schema, DIGITS)


SHAPES = {"stats": _stats, "times": aggregate.times_of, "hits": lambda df, _: aggregate.hits(df), "values": aggregate.values}


def _of(name: str, body: dict, shape: str, schema: TableSchema, change=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return SHAPES[shape](selected(change(df) if change else df, schema, body), schema)

    return run


# SQL of the four shapes, over any relation and condition


def stats_sql(schema: TableSchema, relation: str, where: str = "true") -> str:
    def one(c):
        number = f"case when not isnan({c.name}) then {c.name} end" if c.kind == FLOAT else c.name
        return f"select '{c.name}' as column_name, count({c.name}) as cnt, round(coalesce(sum({c.name}::double), 0), {DIGITS}) as sum_v, min({number})::double as min_v, max({number})::double as max_v from {relation} where {where}"

    return " union all ".join(one(c) for c in schema.visible(INTEGER, FLOAT))


def times_sql(schema: TableSchema, relation: str, where: str = "true") -> str:
    text = lambda x: f"strftime(to_timestamp(floor(epoch({x}))::bigint) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    return " union all ".join(f"select '{c.name}' as column_name, count({c.name}) as cnt, {text(f'min({c.name})')} as oldest, {text(f'max({c.name})')} as newest from {relation} where {where}" for c in schema.visible(DATE_TIME))


def hits_sql(_, relation: str, where: str = "true") -> str:
    return f"select count(*) as matched_rows from {relation} where {where}"


def values_sql(schema: TableSchema, relation: str, where: str = "true") -> str:
    return " union all ".join(f"select '{c.name}' as column_name, {c.name} as value, count(*) as cnt from {relation} where ({where}) and {c.name} is not null group by {c.name}" for c in schema.visible(STRING))


SQL = {"stats": stats_sql, "times": times_sql, "hits": hits_sql, "values": values_sql}

DAY = {"gte": "1995-03-15T00:00:00Z", "lt": "1995-03-16T00:00:00Z"}
_S = "l_shipdate >= timestamp '{}' and l_shipdate < timestamp '{}'"
_NULLS = "(select * replace (nullif(o_orderstatus, 'P') as o_orderstatus, case when o_custkey % 3 = 0 then null else o_totalprice end as o_totalprice) from orders)"
_NAN = "(select * replace (case when l_linenumber = 7 then 'NaN'::double else l_quantity end as l_quantity) from lineitem)"


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({"o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("P")), "o_totalprice": F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice"))})


def _with_nan(df: DataFrame) -> DataFrame:
    return df.withColumn("l_quantity", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")))


def _epoch(text: str) -> int:
    return times.to_seconds(text)


#: name: (table, request, shape, condition in SQL[, change of the table, its SQL])
SPECS: dict[str, tuple] = {
    "q01_match_all_stats": ("lineitem", {}, "stats", "true"),
    "q02_must_one": ("lineitem", {"must": {"l_returnflag": ["R"]}}, "stats", "l_returnflag in ('R')"),
    "q03_must_many": ("lineitem", {"must": {"l_returnflag": ["R", "A"]}}, "stats", "l_returnflag in ('R', 'A')"),
    "q04_must_two_columns": ("lineitem", {"must": {"l_returnflag": ["R", "A", "N"], "l_linestatus": ["O"]}}, "stats", "l_returnflag in ('R', 'A', 'N') and l_linestatus in ('O')"),
    "q05_must_unknown": ("lineitem", {"must": {"l_returnflag": ["no such flag"]}}, "stats", "false"),
    "q06_must_empty": ("lineitem", {"must": {"l_returnflag": []}}, "stats", "false"),
    "q07_must_not_one": ("lineitem", {"must_not": {"l_returnflag": ["R"]}}, "stats", "l_returnflag not in ('R')"),
    "q08_must_not_two_columns": ("lineitem", {"must_not": {"l_returnflag": ["R"], "l_linestatus": ["O"]}}, "stats", "l_returnflag not in ('R') and l_linestatus not in ('O')"),
    "q09_must_not_unknown_or_empty": ("lineitem", {"must_not": {"l_returnflag": ["no such flag"], "l_linestatus": []}}, "stats", "true"),
    "q10_must_and_must_not": ("lineitem", {"must": {"l_returnflag": ["R", "A"]}, "must_not": {"l_returnflag": ["A"]}}, "stats", "l_returnflag in ('R', 'A') and l_returnflag not in ('A')"),
    "q11_range_gte_lt": ("lineitem", {"ranges": {"l_quantity": {"gte": 10, "lt": 20}}}, "stats", "l_quantity >= 10 and l_quantity < 20"),
    "q12_range_gt_lte": ("lineitem", {"ranges": {"l_quantity": {"gt": 10, "lte": 20}}}, "stats", "l_quantity > 10 and l_quantity <= 20"),
    "q13_range_eq_set": ("lineitem", {"ranges": {"l_linenumber": [{"eq": 1}, {"eq": 3}, {"eq": 7}]}}, "stats", "l_linenumber in (1, 3, 7)"),
    "q14_range_or_overlap": ("lineitem", {"ranges": {"l_extendedprice": [{"gte": 1000, "lte": 30000}, {"gt": 20000, "lt": 50000.5}]}}, "stats", "l_extendedprice >= 1000 and l_extendedprice < 50000.5"),
    "q15_range_open_ended": ("lineitem", {"ranges": {"l_discount": {"gte": 0.05}}}, "stats", "l_discount >= 0.05"),
    "q16_range_unbounded": ("lineitem", {"ranges": {"l_discount": {}}}, "stats", "l_discount is not null"),
    "q17_range_empty_list": ("lineitem", {"ranges": {"l_discount": []}}, "stats", "false"),
    "q18_range_contradiction": ("lineitem", {"ranges": {"l_quantity": {"gt": 30, "lt": 10}}}, "stats", "l_quantity > 30 and l_quantity < 10"),
    "q19_bound_precedence": ("lineitem", {"ranges": {"l_quantity": {"gte": 10, "gt": 20, "lte": 40, "lt": 30}, "l_linenumber": {"eq": 5, "gte": 9, "lt": "no time"}}}, "stats", "l_quantity between 10 and 40 and l_linenumber = 5"),
    "q20_range_integer_f64": ("orders", {"ranges": {"o_custkey": {"gt": 10.5, "lte": 900.25}}}, "stats", "o_custkey::double > 10.5 and o_custkey::double <= 900.25"),
    "q21_full_day": ("lineitem", {"ranges": {"l_shipdate": DAY}}, "stats", _S.format("1995-03-15", "1995-03-16")),
    "q22_two_windows": ("lineitem", {"ranges": {"l_shipdate": [{"gte": "1998-01-01T00:00:00Z", "lt": "1998-07-01T00:00:00Z"}, {"gte": "1996-01-01T00:00:00Z", "lt": "1996-04-01T00:00:00Z"}]}}, "stats", f"({_S.format('1998-01-01', '1998-07-01')}) or ({_S.format('1996-01-01', '1996-04-01')})"),
    "q24_numeric_bound_on_datetime": ("lineitem", {"ranges": {"l_shipdate": {"gte": _epoch("1997-01-01T00:00:00Z") + 0.5, "lt": float(_epoch("1998-01-01T00:00:00Z"))}}}, "stats", "floor(epoch(l_shipdate)) >= 852076800.5 and floor(epoch(l_shipdate)) < 883612800"),
    "q25_offset_bound": ("lineitem", {"ranges": {"l_shipdate": {"gte": "1997-01-01T00:00:00+02:00", "lte": "1997-12-31T22:30:00-01:30"}}}, "stats", "l_shipdate >= timestamp '1996-12-31 22:00:00' and floor(epoch(l_shipdate)) <= epoch(timestamp '1998-01-01 00:00:00')"),
    "q26_oldest_newest": ("lineitem", {"must": {"l_returnflag": ["R"]}}, "times", "l_returnflag = 'R'"),
    "q26_oldest_newest_orders": ("orders", {}, "times", "true"),
    "q26_oldest_newest_subsecond": ("events", {"must": {"event_type": ["click"]}}, "times", "event_type = 'click'"),
    "q27_string_counts": ("lineitem", {}, "values", "true"),
    "q28_string_counts_filtered": ("lineitem", {"must": {"l_returnflag": ["R", "N"]}, "ranges": {"l_quantity": {"lt": 25}}}, "values", "l_returnflag in ('R', 'N') and l_quantity < 25"),
    "q29_hidden_filter_only": ("lineitem", {"ranges": {"l_suppkey": {"gte": 1, "lte": 5}}}, "stats", "l_suppkey between 1 and 5"),
    "q30_integer_stats_double": ("orders", {"must": {"o_orderpriority": ["1-URGENT", "5-LOW"]}}, "stats", "o_orderpriority in ('1-URGENT', '5-LOW')"),
    "q31_null_must": ("orders", {"must": {"o_orderstatus": ["F", "O", "P"]}}, "stats", "o_orderstatus in ('F', 'O', 'P')", _with_nulls, _NULLS),
    "q32_null_must_not": ("orders", {"must_not": {"o_orderstatus": ["F"]}}, "stats", "o_orderstatus is null or o_orderstatus not in ('F')", _with_nulls, _NULLS),
    "q33_null_range": ("orders", {"ranges": {"o_totalprice": {"gte": 0}}}, "stats", "o_totalprice >= 0", _with_nulls, _NULLS),
    "q34_null_count": ("orders", {}, "stats", "true", _with_nulls, _NULLS),
    "q35_nan_rules": ("lineitem", {"ranges": {"l_quantity": {"gt": 10}}}, "stats", "not isnan(l_quantity) and l_quantity > 10", _with_nan, _NAN),
    "q35_nan_unbounded": ("lineitem", {"ranges": {"l_quantity": {}, "l_linenumber": [{"eq": 7}, {"eq": 1}]}}, "hits", "l_linenumber in (1, 7)", _with_nan, _NAN),
    "q39_bench_window": ("orders", {"ranges": {"o_orderdate": {"gte": "1996-02-01T00:00:00Z", "lt": "1999-08-01T00:00:00Z"}}}, "stats", "o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1999-08-01'"),
    "q40_bench_window_and_in": ("orders", {"ranges": {"o_orderdate": {"gte": "1996-02-01T00:00:00Z", "lt": "1999-08-01T00:00:00Z"}}, "must": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, "stats", "o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1999-08-01' and o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "q41_bench_two_windows": ("events", {"ranges": {"ts": [{"gte": "2024-01-03T00:00:00Z", "lt": "2024-01-09T00:00:00Z"}, {"gte": "2024-01-06T00:00:00Z", "lt": "2024-01-20T00:00:00Z"}]}}, "stats", "ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-20'"),
    "q42_bench_two_windows_and_in": ("events", {"ranges": {"ts": [{"gte": "2024-01-03T00:00:00Z", "lt": "2024-01-09T00:00:00Z"}, {"gte": "2024-01-12T00:00:00Z", "lt": "2024-01-20T00:00:00Z"}]}, "must": {"event_type": ["purchase"]}}, "stats", "((ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-09') or (ts >= timestamp '2024-01-12' and ts < timestamp '2024-01-20')) and event_type = 'purchase'"),
    "q48_status_rows_loaded": ("lineitem", {}, "hits", "true"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"must": {"l_returnflag": ["R", "A"]}, "ranges": {"l_shipdate": {"gte": "1997-01-01T00:00:00Z", "lt": "1998-01-01T00:00:00Z"}}}
    return _stats(selected(table(spark, sf_dir, "lineitem"), LINEITEM, body), LINEITEM)


# bounds inside a second: events.ts has fractions

_MIDDLE = "2024-01-15T12:00:00Z"
_SUB = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<", "eq": "="}


def _subsecond(op: str):
    """Bounds at a whole second in which an event lies: found by an aggregate of one row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events")
        second = df.agg(times.of_stamp(F.max("ts")).alias("s")).first()["s"]
        return aggregate.hits(selected(df, EVENTS, {"ranges": {"ts": {op: second}}}))

    return run


def _sorted_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = zones.ordered(table(spark, sf_dir, "lineitem"), LINEITEM, "l_shipdate")
    return _stats(selected(df, LINEITEM, {"ranges": {"l_shipdate": DAY}}), LINEITEM)


ZONE = 4096


def _zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return zones.zones(df, times.of_stamp("l_shipdate"), ZONE)


def _zones_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = float(_epoch("1997-01-01T00:00:00Z")), float(_epoch("1998-01-01T00:00:00Z"))
    hit = zones.overlapping(_zone_table(spark, sf_dir), (Range((low, True), (high, False)),))
    return hit.agg(F.count(F.lit(1)).alias("zones_hit"))


_ZONES_SQL = f"""select (rn // {ZONE})::bigint as zone, min(k) as zone_min, max(k) as zone_max from
(select floor(epoch(l_shipdate))::bigint as k, row_number() over (order by l_shipdate) - 1 as rn from lineitem) group by 1"""


# round trips through files of our own


def _folder(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = tempfile.mkdtemp(prefix="quernstone-files-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base}/files-{uuid.uuid4().hex}"


_ORDER_FILE = TableSchema.of({"o_totalprice": FLOAT, "o_custkey": INTEGER, "o_orderpriority": STRING, "o_orderdate": DATE_TIME}, {"o_orderkey": INTEGER})


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return df.select(F.col("o_orderkey").cast("string"), stamp.alias("o_orderdate"), "o_orderpriority", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"), F.lit('say "x", y').alias("note"))


def _csv_round_trip(gzip: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        _as_text(spark, sf_dir).write.option("header", "true").option("escape", '"').option("compression", "gzip" if gzip else "none").csv(path)
        df = csv.scan(spark, path, _ORDER_FILE, gzip=gzip)
        return _stats(selected(df, _ORDER_FILE, {"must_not": {"o_orderpriority": ["5-LOW"]}, "ranges": {"o_orderdate": {"gte": "1997-01-01T00:00:00Z"}}}), _ORDER_FILE)

    return run


def _configured_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a configuration names it: cells parted by semicolons, no line breaks in them."""
    path = _folder(spark)
    _as_text(spark, sf_dir).write.option("header", "true").option("escape", '"').option("sep", ";").csv(path)
    columns = "".join(f'[searchable.{c.name}]\ntype = "{c.kind}"\nhidden = {str(c.hidden).lower()}\n' for c in _ORDER_FILE.columns)
    settings = config.parse(f'[source]\ntype = "csv"\npath = "{path}"\ndelimiter = ";"\nmultiline = false\n[engine]\nmemory_limit = "64G"\nchunk_size_rows = 65536\nworker_threads = 2\n[api]\nbind = "127.0.0.1:0"\n{columns}')
    df = select.scan(spark, settings)
    return aggregate.times_of(selected(df, settings.schema, {"must": {"o_orderpriority": ["2-HIGH", "3-MEDIUM"]}}), settings.schema)


_CUSTOMER_FILE = TableSchema.of({"c_acctbal": FLOAT, "c_nationkey": INTEGER, "c_mktsegment": STRING}, {"c_custkey": INTEGER})


def _sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tempfile.mkdtemp(prefix="quernstone-sqlite-")  # a SQLite file is one local file: a fixture, not a sink
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "t.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "a ""table""" (c_custkey INTEGER, c_acctbal REAL, c_nationkey INTEGER, c_mktsegment TEXT, spare TEXT)')
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").toLocalIterator()
        c.executemany('INSERT INTO "a ""table""" VALUES (?, ?, ?, ?, NULL)', (tuple(r) for r in rows))
    df = sqlite.scan(spark, path, 'a "table"', _CUSTOMER_FILE)
    return _stats(selected(df, _CUSTOMER_FILE, {"must": {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "ranges": {"c_acctbal": {"lt": 0}}}), _CUSTOMER_FILE)


#: (kind, cell, its value as text, or None where it must be refused)
CELLS = [
    (INTEGER, " 42 ", "42"), (INTEGER, "+5", "5"), (INTEGER, "-0", "0"), (INTEGER, "1.0", None), (INTEGER, "1e3", None), (INTEGER, "1_000", None), (INTEGER, "9223372036854775807", "9223372036854775807"), (INTEGER, "9223372036854775808", None),
    (FLOAT, ".5", "0.5"), (FLOAT, "5.", "5.0"), (FLOAT, "1.0d", None), (FLOAT, "1f", None), (FLOAT, "0x1p3", None), (FLOAT, "nan", "NaN"), (FLOAT, "-inf", "-Infinity"), (FLOAT, "1E2", "100.0"),
    (DATE_TIME, "2026", None), (DATE_TIME, "2026-04-19", None), (DATE_TIME, "T12:00:00Z", None), (DATE_TIME, "2026-4-9T1:2:3Z", None), (DATE_TIME, "2026-04-19T00:00:00", None), (DATE_TIME, "2026-04-19t00:00:00z", "1776556800"),
    (DATE_TIME, "2026-04-19T02:00:00.999+02:00", "1776556800"), (DATE_TIME, "1969-12-31T23:59:59.5Z", "-1"), (DATE_TIME, "2026-02-30T00:00:00Z", None), (DATE_TIME, "2026-04-19T24:00:00Z", None),
]


def _coercion_matrix(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame([(i, k, c) for i, (k, c, _) in enumerate(CELLS)], "n int, kind string, cell string")
    value = F.when(F.col("kind") == INTEGER, coerce.parsed(F.col("cell"), INTEGER).cast("string")).when(F.col("kind") == FLOAT, coerce.parsed(F.col("cell"), FLOAT).cast("string")).otherwise(coerce.parsed(F.col("cell"), DATE_TIME).cast("string"))
    return rows.select("n", "kind", "cell", value.alias("value"), value.isNull().alias("refused"))


def _coercion_sql() -> str:
    quote = lambda s: "null" if s is None else "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}::integer, {quote(k)}, {quote(c)}, {quote(v)}::varchar, {str(v is None).lower()})" for i, (k, c, v) in enumerate(CELLS))
    return f"select * from (values {rows}) as t(n, kind, cell, value, refused)"


def _request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of requests: how many, and how many errors, in the last minute, hour and day before the newest."""
    df = table(spark, sf_dir, "events").select(times.of_stamp("ts").alias("s"), (F.col("event_type") == "error").alias("bad"))
    newest = df.agg(F.max("s").alias("now"))
    age = F.col("now") - F.col("s")
    spans = {"last_1m": 60, "last_1h": 3600, "last_24h": 86400}
    counts = [F.sum(F.when((age < n) & bad, 1).otherwise(0)).cast("long").alias(f"{kind}_{name}") for kind, bad in (("queries", F.lit(True)), ("errors", F.col("bad"))) for name, n in spans.items()]
    return df.join(F.broadcast(newest)).agg(*counts)  # one row is broadcast


def _request_counts_sql() -> str:
    spans = {"last_1m": 60, "last_1h": 3600, "last_24h": 86400}
    columns = ", ".join(f"sum(case when now - s < {n}{extra} then 1 else 0 end)::bigint as {kind}_{name}" for kind, extra in (("queries", ""), ("errors", " and bad")) for name, n in spans.items())
    return f"with e as (select floor(epoch(ts))::bigint as s, event_type = 'error' as bad from events), m as (select max(s) as now from e) select {columns} from e, m"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TableSchema.of({"p_brand": STRING, "p_type": STRING})
    return aggregate.dictionary(table(spark, sf_dir, "part"), schema)


def queries() -> dict:
    out = {}
    for name, (source, body, shape, _, *more) in SPECS.items():
        out[name] = _of(source, body, shape, SCHEMAS[source], more[0] if more else None)
    out |= {f"q23_subsecond_{op}": _subsecond(op) for op in _SUB}
    out |= {
        "flagship": flagship,
        "q36_partition_sorted_same_answer": _sorted_same,
        "q37_zone_stats": _zone_table,
        "q38_zones_overlapping": _zones_hit,
        "q43_csv_round_trip": _csv_round_trip(False),
        "q44_csv_gzip": _csv_round_trip(True),
        "q45_sqlite_scan": _sqlite_scan,
        "q46_coercion_matrix": _coercion_matrix,
        "q47_sliding_request_counts": _request_counts,
        "q49_dictionary_profile": _dictionary,
        "q55_answer_rows": lambda spark, sf_dir: control.answer(table(spark, sf_dir, "lineitem"), LINEITEM),
        "q56_configured_csv": _configured_csv,
    } | control.queries()
    return dict(sorted(out.items()))


@functools.cache
def oracle_sql() -> dict[str, str]:
    out = {name: SQL[shape](SCHEMAS[source], more[1] if more else source, where) for name, (source, _, shape, where, *more) in SPECS.items()}
    out |= {f"q23_subsecond_{op}": f"select count(*) as matched_rows from events where floor(epoch(ts)) {sign} (select floor(epoch(max(ts))) from events)" for op, sign in _SUB.items()}
    orders = "(select o_totalprice, o_custkey, o_orderpriority, o_orderdate from orders)"
    return out | {
        "flagship": stats_sql(LINEITEM, "lineitem", f"l_returnflag in ('R', 'A') and {_S.format('1997-01-01', '1998-01-01')}"),
        "q36_partition_sorted_same_answer": stats_sql(LINEITEM, "lineitem", _S.format("1995-03-15", "1995-03-16")),
        "q37_zone_stats": _ZONES_SQL,
        "q38_zones_overlapping": f"select count(*) as zones_hit from ({_ZONES_SQL}) where zone_max >= 852076800 and zone_min < 883612800",
        "q43_csv_round_trip": stats_sql(_ORDER_FILE, orders, "o_orderpriority <> '5-LOW' and o_orderdate >= timestamp '1997-01-01'"),
        "q44_csv_gzip": stats_sql(_ORDER_FILE, orders, "o_orderpriority <> '5-LOW' and o_orderdate >= timestamp '1997-01-01'"),
        "q45_sqlite_scan": stats_sql(_CUSTOMER_FILE, "customer", "c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal < 0"),
        "q46_coercion_matrix": _coercion_sql(),
        "q47_sliding_request_counts": _request_counts_sql(),
        "q55_answer_rows": control.answer_sql(LINEITEM, "l_returnflag in ('R', 'A') and l_quantity >= 3 and l_quantity < 40"),
        "q56_configured_csv": times_sql(_ORDER_FILE, "(select o_orderdate, o_orderpriority from orders)", "o_orderpriority in ('2-HIGH', '3-MEDIUM')"),
        "q49_dictionary_profile": " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as cardinality, count({c})::bigint as non_null from part" for c in ("p_brand", "p_type")),
    } | control.oracle_sql()
