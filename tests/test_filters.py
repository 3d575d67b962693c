import datetime as dt
import math
import random

import pytest

from quernstone.errors import BoundError, QueryError, RequestError
from quernstone.operators import aggregate, predicate, zones
from quernstone.operators.predicate import Range
from quernstone.operators.schema import TableSchema
from quernstone.plans import request, response

SCHEMA = TableSchema.of({"weight": "float", "breed": "string", "tag": "integer"})
HERD = [(612.5, "angus", 31), (540.25, "jersey", 32), (498.0, "jersey", 35), (701.75, "zebu", 38), (455.5, "angus", 40), (530.0, "dexter", 41), (389.25, "jersey", 47)]
GAPS = [(612.5, "angus", 31), (None, "jersey", 32), (498.0, None, 35), (701.75, "zebu", None), (None, None, 40), (530.0, "dexter", 41), (389.25, "jersey", 47)]
TYPES = "weight double, breed string, tag long"


def answer(spark, rows, body, counts=False, schema=SCHEMA, types=TYPES):
    df = predicate.matching(spark.createDataFrame(rows, types), request.parse(body), schema)
    return response.shaped(aggregate.summary(df, schema).first(), aggregate.values(df, schema).collect() if counts else [], schema)


@pytest.mark.parametrize(
    ("rows", "body", "matched", "count", "total"),
    [
        (HERD, {}, 7, 7, 3727.25),
        (HERD, {"must": {"breed": ["angus", "zebu"]}}, 3, 3, 1769.75),
        (HERD, {"must_not": {"breed": ["jersey"]}}, 4, 4, 2299.75),
        (HERD, {"must_not": {"breed": ["jersey", "angus"]}, "ranges": {"tag": {"lte": 40}}}, 1, 1, 701.75),
        (HERD, {"ranges": {"weight": {"gt": 498, "lte": 612.5}}}, 3, 3, 1682.75),
        (HERD, {"ranges": {"weight": [{"lt": 400}, {"gte": 700}], "tag": {"gt": 31}}}, 2, 2, 1091.0),
        (HERD, {"must": {"breed": ["longhorn"]}}, 0, 0, 0.0),
        (HERD, {"must": {"breed": ["zebu ", "Zebu"]}}, 0, 0, 0.0),
        (GAPS, {}, 7, 5, 2731.5),
        (GAPS, {"ranges": {"weight": {"gte": -1}}}, 5, 5, 2731.5),
        (GAPS, {"ranges": {"weight": {}}}, 5, 5, 2731.5),
        (GAPS, {"ranges": {"tag": [{}, {"eq": 31}]}}, 6, 4, 2029.75),
        (GAPS, {"must_not": {"breed": ["zebu", "dexter"]}}, 5, 3, 1499.75),
        (GAPS, {"must": {"breed": ["jersey", "dexter"]}}, 3, 2, 919.25),
    ],
)
def test_clauses(spark, rows, body, matched, count, total):
    out = answer(spark, rows, body)
    assert out["matched_rows"] == matched
    assert (out["numeric"]["weight"]["count"], out["numeric"]["weight"]["sum"]) == (count, total)
    assert "breed" not in out["numeric"] and "string_counts" not in out
    assert ("min" in out["numeric"]["weight"]) == (count > 0)


def test_string_counts(spark):
    assert answer(spark, HERD, {}, True)["string_counts"] == {"breed": {"angus": 2, "dexter": 1, "jersey": 3, "zebu": 1}}
    assert answer(spark, GAPS, {"ranges": {"weight": {"lt": 600}}}, True)["string_counts"] == {"breed": {"dexter": 1, "jersey": 1}}


def test_nan_infinity_and_hidden(spark):
    schema = TableSchema.of({"x": "float"}, {"k": "integer"})
    nan = float("nan")
    rows = [(nan, 1), (1.0, 2), (-0.0, 3), (float("inf"), 4), (None, 5)]
    found = answer(spark, rows, {}, schema=schema, types="x double, k long")
    assert found["numeric"] == {"x": {"count": 4, "sum": None, "min": 0.0, "max": None}}
    assert answer(spark, rows, {"ranges": {"x": {"gt": -1}}}, schema=schema, types="x double, k long")["matched_rows"] == 3
    assert answer(spark, rows, {"ranges": {"x": {"eq": 0}}}, schema=schema, types="x double, k long")["matched_rows"] == 1
    assert answer(spark, [(nan, 1)], {}, schema=schema, types="x double, k long")["numeric"]["x"] == {"count": 1, "sum": None, "min": None, "max": None}


def test_integers_compare_as_doubles(spark):
    schema, big = TableSchema.of({"k": "integer"}), 2**53
    rows = [(big - 1,), (big,), (big + 1,)]
    count = lambda b: answer(spark, rows, {"ranges": {"k": b}}, schema=schema, types="k long")["matched_rows"]
    assert count({"eq": big}) == 2  # 2^53 + 1 rounds to 2^53
    assert count({"gt": big}) == 0
    assert count({"gte": big - 0.5}) == 2
    assert count({"lt": big - 1}) == 0


def naive(rows, schema, query):
    def ok(row):
        cells = dict(zip(schema.names, row, strict=True))
        if any(cells[n] is None or cells[n] not in v for n, v in query.must.items()):
            return False
        if any(cells[n] is not None and cells[n] in v for n, v in query.must_not.items()):
            return False
        for n, rs in query.ranges.items():
            x = cells[n]
            if x is None:
                return False
            x = math.floor((x - dt.datetime(1970, 1, 1)).total_seconds()) if isinstance(x, dt.datetime) else float(x)
            if not any((r.low is None or (x >= r.low[0] if r.low[1] else x > r.low[0])) and (r.high is None or (x <= r.high[0] if r.high[1] else x < r.high[0])) for r in rs):
                return False
        return True

    return [r for r in rows if ok(r)]


def test_random_queries_agree_with_a_naive_evaluator(spark):
    rng = random.Random(7)
    schema = TableSchema.of({"a": "float", "b": "integer", "s": "string", "t": "date-time"})
    start = dt.datetime(1969, 12, 31, 23, 59, 50)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick(None, float("nan"), float("inf"), -0.0, rng.uniform(-5, 5), 2.0), pick(None, rng.randint(-5, 5)), pick(None, "x", "y", "Y", " x"), pick(None, start + dt.timedelta(microseconds=rng.randint(0, 20_000_000)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b int, s string, t timestamp_ntz").repartition(3).cache()

    def bounds(n):
        out = {k: pick(rng.randint(-6, 6), rng.uniform(-6, 6), 2.0) for k in ("gt", "gte", "lt", "lte") if rng.random() < 0.4}
        return out | ({"eq": rng.randint(-3, 3)} if rng.random() < 0.15 else {}) | ({"gte": pick("1969-12-31T23:59:58Z", "1970-01-01T02:00:01+02:00")} if n == "t" and rng.random() < 0.5 else {})

    for _ in range(40):
        body = {"must": {"s": rng.sample(["x", "y", "Y", "no"], rng.randint(0, 3))} if rng.random() < 0.4 else {}, "must_not": {"s": rng.sample(["x", "y", " x"], rng.randint(0, 2))} if rng.random() < 0.4 else {}}
        body["ranges"] = {n: [bounds(n) for _ in range(rng.randint(0, 3))] for n in "abt" if rng.random() < 0.4}
        query = request.parse(body)
        want = naive(rows, schema, query)
        row = aggregate.summary(predicate.matching(df, query, schema), schema).first()
        assert row["matched_rows"] == len(want), body
        numbers = [r[1] for r in want if r[1] is not None]
        assert (row["n1"], row["sum1"]) == (len(numbers), float(sum(numbers)))
        assert (row["lo1"], row["hi1"]) == ((min(numbers), max(numbers)) if numbers else (None, None))
        floats = [r[0] for r in want if r[0] is not None and not math.isnan(r[0])]
        assert (row["lo0"], row["hi0"]) == ((min(floats), max(floats)) if floats else (None, None))


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(float(i), i, "x") for i in range(10)], TYPES.replace("breed string, tag long", "tag long, breed string")).write.parquet(path)
    df = predicate.matching(spark.read.parquet(path), request.parse({"ranges": {"tag": [{"gt": 2.5, "lte": 4}, {"eq": 7}], "weight": {"gte": 1}}, "must": {"breed": ["x"]}}), SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = next(line for line in plan.split("\n") if "PushedFilters" in line).split("PushedFilters")[1]
    for part in ("EqualTo(breed,x)", "IsNotNull(tag)", "Or(And(GreaterThanOrEqual(tag,3)"):
        assert part in plan
    assert df.count() == 3


@pytest.mark.parametrize(
    ("body", "error", "status"),
    [
        ("{", RequestError, 400), ("[]", RequestError, 422), ('{"what": {}}', RequestError, 422), ('{"must": {"c": [1]}}', RequestError, 422), ('{"must": {"c": "x"}}', RequestError, 422), ('{"must": null}', RequestError, 422),
        ('{"ranges": {"a": {"ge": 1}}}', RequestError, 422), ('{"ranges": {"a": {"gte": true}}}', RequestError, 422), ('{"ranges": {"a": {"gte": NaN}}}', RequestError, 400), ('{"ranges": {"a": {"gte": "2024-01-01"}}}', BoundError, None),
    ],
)
def test_bad_requests(body, error, status):
    with pytest.raises(error) as e:
        request.parse(body)
    assert status is None or e.value.status == status


def test_bounds():
    parse = lambda r: request.parse({"ranges": {"a": r}}).ranges["a"]
    assert parse({"gte": 10, "gt": 20, "lte": 40, "lt": 30}) == (Range((10, True), (40, True)),)
    assert parse({"eq": 5, "gte": "no time"}) == (Range((5, True), (5, True)),)
    assert parse({"gte": None, "gt": "1970-01-01T00:00:09.9Z"}) == (Range((9, False), None),)
    assert parse([{}, {"lt": 1}]) == (Range(), Range(None, (1, False)))
    assert parse([]) == ()


def test_columns_are_checked(spark):
    for body in ({"must": {"no": ["x"]}}, {"must": {"weight": ["x"]}}, {"must_not": {"tag": []}}, {"ranges": {"breed": {}}}, {"ranges": {"no": []}}):
        with pytest.raises(QueryError):
            answer(spark, HERD, body)


def test_zones(spark):
    keys = [8, -2, 4, 4, 4, 4, 4, 11, 10**12, 3, None]  # a null counts as 0
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = sorted(map(tuple, zones.zones(df, df["k"], 3).collect()))
    assert rows == [(0, -2, 3), (1, 4, 4), (2, 4, 8), (3, 11, 10**12)]
    hit = {r[0] for r in zones.overlapping(zones.zones(df, df["k"], 3), (Range((11, True), None), Range(None, (-1, False)))).collect()}
    assert hit == {0, 3}
    assert zones.zones(df.where("false"), df["k"], 3).count() == 0


def test_order_is_stable_and_nulls_count_as_zero(spark):
    schema = TableSchema.of({"k": "integer", "n": "integer"})
    keys = [5, None, -1, 5, 0, None, 5, 2, -1, 0]
    df = spark.createDataFrame(list(enumerate(keys)), "n long, k long").coalesce(1)
    found = [r["n"] for part in zones.ordered(df, schema, "k", 3).rdd.glom().collect() for r in part]
    assert found == sorted(range(len(keys)), key=lambda i: (keys[i] or 0, i))


def test_zoned_timestamps(spark):
    """A timestamp with a zone is an instant, whatever the session's zone."""
    schema = TableSchema.of({"t": "date-time"})
    df = spark.sql("select timestamp_micros(cast(m as bigint)) as t from values (0), (999999), (1000000), (-1), (1262304000500000) as v(m)")
    assert answer_of(df, {"ranges": {"t": {"gte": "1970-01-01T00:00:00Z", "lte": 0}}}, schema) == (2, 0, 0)
    assert answer_of(df, {"ranges": {"t": {"eq": "2010-01-01T00:00:00Z"}}}, schema) == (1, 1262304000, 1262304000)
    assert answer_of(df, {"ranges": {"t": {"lt": "1970-01-01T00:00:00Z"}}}, schema) == (1, -1, -1)
    assert answer_of(df, {}, schema) == (5, -1, 1262304000)


def answer_of(df, body, schema):
    row = aggregate.summary(predicate.matching(df, request.parse(body), schema), schema).first()
    return row["matched_rows"], row["lo0"], row["hi0"]
