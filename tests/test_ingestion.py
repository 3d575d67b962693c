import gzip
import json
import os
import sqlite3
import threading
import time
import urllib.error
import urllib.request

import pytest

from quernstone import config, http
from quernstone import engine as engine_module
from quernstone.engine import Engine, check_memory, ingest
from quernstone.errors import ConfigError, EngineError, IngestionError, QueryError, StorageError
from quernstone.functions import coerce, times
from quernstone.operators.schema import TableSchema
from quernstone.plans import catalogue
from quernstone.sources import csv, sqlite
from quernstone.streaming.counters import Counters
from quernstone.streaming.reload import Loader, Watcher, first

TEXT = """well,depth,rock,crew,drilled
71,812.25,basalt,north,2019-06-30T22:15:00Z
72,64.00,chalk,north,2019-07-04T05:00:00Z
75,1300.75,gneiss,south,2020-02-29T12:00:00Z
"""
SCHEMA = TableSchema.of({"well": "integer", "depth": "float", "rock": "string", "crew": "string", "drilled": "date-time"})
ROWS = [("north", 812.25, 1561932900, "basalt", 71), ("north", 64.0, 1562216400, "chalk", 72), ("south", 1300.75, 1582977600, "gneiss", 75)]


def rows(spark, path, text, schema=SCHEMA, **options):
    data = text if isinstance(text, bytes) else text.encode()
    path.write_bytes(data)
    return [tuple(r) for r in csv.scan(spark, str(path), schema, **options).sort("well").collect()]


def test_csv(spark, tmp_path):
    want = ROWS
    assert rows(spark, tmp_path / "a.csv", TEXT) == want
    assert rows(spark, tmp_path / "a.csv.gz", gzip.compress(TEXT.encode()), gzip=True) == want
    assert rows(spark, tmp_path / "packed.csv", gzip.compress(TEXT.encode()), gzip=True) == want  # the flag decides, not the name
    assert rows(spark, tmp_path / "plain.gz", TEXT) == want
    assert rows(spark, tmp_path / "tabs.csv", TEXT.replace(",", "\t"), delimiter="\t") == want
    assert rows(spark, tmp_path / "lines.csv", TEXT, multiline=False) == want
    assert rows(spark, tmp_path / "empty.csv", TEXT.splitlines()[0] + "\n") == []


def test_csv_cells(spark, tmp_path):
    schema = TableSchema.of({"well": "integer", "rock": "string"})
    text = 'rock,well,rock\n" tuff,""grey""\nwet",4,no\n  ,5,no\nmarl , 6 ,no\n'
    assert rows(spark, tmp_path / "a.csv", text, schema) == [(' tuff,"grey"\nwet', 4), (None, 5), ("marl ", 6)]


@pytest.mark.parametrize("bad", ["76,12.5,loam,south\n", "7,6,5,4,3,2\n", "x,3,loam,south,2019-07-04T05:00:00Z\n", "7.0,3,loam,south,2019-07-04T05:00:00Z\n", "7,3f,loam,south,2019-07-04T05:00:00Z\n", "7,3,loam,south,2019-07-04\n"])
def test_bad_rows_end_the_load(spark, tmp_path, bad):
    path = tmp_path / "a.csv"
    path.write_text(TEXT + bad)
    text = f'partition_column = "drilled"\n[source]\ntype = "csv"\npath = "{path}"\n[engine]\nmemory_limit = "64G"\nchunk_size_rows = 2\nworker_threads = 2\n[api]\nbind = "127.0.0.1:0"\n' + "".join(f'[searchable.{c.name}]\ntype = "{c.kind}"\n' for c in SCHEMA.columns)
    with pytest.raises(IngestionError):
        ingest(spark, config.parse(text))


def test_missing_column(spark, tmp_path):
    with pytest.raises(IngestionError, match="drilled"):
        rows(spark, tmp_path / "a.csv", TEXT.replace("drilled", "when"))


def test_coercion_of_cells_agrees_with_columns(spark):
    for kind, cell, value in catalogue.CELLS:
        if value is None:
            with pytest.raises(IngestionError, match="column"):
                coerce.cell("c", kind, cell)
        else:
            found = coerce.cell("c", kind, cell)
            assert str(found) == str(float(value.replace("Infinity", "inf"))) if kind == "float" else str(found) == value
    got = catalogue._coercion_matrix(spark, "").collect()
    assert [(r["value"]) for r in sorted(got, key=lambda r: r["n"])] == [v for _, _, v in catalogue.CELLS]


def test_dynamic_cells():
    assert coerce.cell("c", "integer", 3.0) == 3 and coerce.cell("c", "date-time", 7) == 7 and coerce.cell("c", "float", 2) == 2.0
    assert coerce.cell("c", "string", " 　") is None and coerce.cell("c", "integer", "　 4 ") == 4
    for kind, value in (("integer", 1.5), ("integer", float("inf")), ("string", 1), ("date-time", 1.0), ("float", "x")):
        with pytest.raises(IngestionError):
            coerce.cell("c", kind, value)


def test_times():
    assert times.to_seconds("1969-12-31T23:59:59.9Z") == -1 and times.text_of(-1) == "1969-12-31T23:59:59+00:00"
    assert times.to_seconds("2019-07-01T00:15:00+02:00") == 1561932900


def database(path):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE wells (drilled, crew TEXT NOT NULL, rock TEXT, depth REAL, well INTEGER NOT NULL)")
        c.executemany("INSERT INTO wells VALUES (?, ?, ?, ?, ?)", [("2019-06-30T22:15:00Z", "north", "basalt", 812.25, 71), (1562216400, "north", "chalk", None, 72), ("2020-02-29T12:00:00Z", "south", None, 1300.75, 75)])
    return str(path)


def test_sqlite(spark, tmp_path):
    path = database(tmp_path / "e.db")
    assert [tuple(r) for r in sqlite.scan(spark, path, "wells", SCHEMA).sort("well").collect()] == [ROWS[0], ("north", None, 1562216400, "chalk", 72), ("south", 1300.75, 1582977600, None, 75)]
    assert sqlite.quoted('has"quote') == '"has""quote"'
    for table, schema in (("nowhere", SCHEMA), ("wells", TableSchema.of({"no": "integer"}))):
        with pytest.raises(IngestionError, match="nowhere|no"):
            sqlite.scan(spark, path, table, schema)
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO wells VALUES (1, 'south', x'00', 1, 9)")
    with pytest.raises(Exception, match="blob"):
        sqlite.scan(spark, path, "wells", SCHEMA).collect()
    text = f'[source]\ntype = "sqlite"\npath = "{path}"\ntable = "wells"\n[engine]\nmemory_limit = "64G"\nchunk_size_rows = 2\nworker_threads = 2\n[api]\nbind = "127.0.0.1:0"\n[searchable.rock]\ntype = "string"\n'
    with pytest.raises(IngestionError, match="blob"):
        ingest(spark, config.parse(text))


def test_sqlite_rowids_far_apart(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "far.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE far (id INTEGER PRIMARY KEY, x REAL)")
        c.executemany("INSERT INTO far VALUES (?, ?)", [(i * 10**15 - 5, float(i)) for i in range(-9, 9000, 9)])
    monkeypatch.setattr(sqlite, "PART_BYTES", 4096)
    schema = TableSchema.of({"id": "integer", "x": "float"})
    reader = sqlite.Reader(path, "far", list(schema.columns))
    parts = reader.partitions()
    assert 1 < len(parts) <= sqlite.PARTS
    assert sorted(x for p in parts for _, x in reader.read(p)) == sorted(r["x"] for r in sqlite.scan(spark, path, "far", schema).collect()) == [float(i) for i in range(-9, 9000, 9)]


CONFIG = """
partition_column = "drilled"
[source]
type = "csv"
path = "{path}"
[engine]
memory_limit = "64GiB"
chunk_size_rows = 2
worker_threads = 2
string_value_counts = true
[api]
bind = "127.0.0.1:0"
[searchable.well]
type = "integer"
hidden = true
[searchable.depth]
type = "float"
[searchable.rock]
type = "string"
[searchable.drilled]
type = "date-time"
"""


def test_config(tmp_path):
    s = config.parse(CONFIG.format(path="x"))
    assert s.schema.names == ["depth", "drilled", "rock", "well"] and s.schema.get("well").hidden and not s.schema.get("depth").hidden
    assert (s.reload_interval_mins, s.partition_column, s.source.delimiter, s.source.gzip) == (0, "drilled", ",", False)
    for broken in ("nonsense", CONFIG.replace("chunk_size_rows = 2", "chunk_size_rows = 0"), CONFIG.replace('type = "float"', 'type = "decimal"'), CONFIG.replace("hidden = true", 'partition_column = "x"'), CONFIG.replace('"csv"', '"parquet"'), CONFIG.replace("worker_threads = 2\n", "")):
        with pytest.raises(ConfigError):
            config.parse(broken)
    with pytest.raises(ConfigError):
        config.load(str(tmp_path / "none.toml"))


def test_byte_sizes():
    for text, power in (("", 0), ("B", 0), ("K", 1), ("kb", 1), ("KiB", 1), ("m", 2), ("MB", 2), ("MiB", 2), ("Gb", 3), ("giB", 3), ("t", 4), ("TB", 4), ("TiB", 4)):
        for n in (1, 7, 650):
            assert config.byte_size(f"{n}{text}") == config.byte_size(f" {n}  {text} ") == n * 1024**power
    assert config.byte_size(77) == 77 and config.byte_size("12_500_000") == 12_500_000 and config.byte_size("0x".replace("x", "")) == 0
    for bad in (" ", "KiB", "3 furlongs", "5 EB", "1.5K", "-1", f"{1 << 54}K", True, None, 2.5):
        with pytest.raises(ConfigError):
            config.byte_size(bad)


def test_counters():
    now = [1000.0]
    c = Counters(lambda: now[0])
    c.record(False)
    c.record(True)
    now[0] += 59
    assert c.snapshot()["queries"] == {"last_1m": 2, "last_1h": 2, "last_24h": 2} and c.snapshot()["errors"]["last_1m"] == 1
    now[0] += 1
    assert c.snapshot()["queries"] == {"last_1m": 0, "last_1h": 2, "last_24h": 2}
    now[0] += 86400 - 60
    c.record(False)  # the bucket of the first two is used again
    assert c.snapshot()["queries"] == {"last_1m": 1, "last_1h": 1, "last_24h": 1}


def test_memory_limit(spark, tmp_path, monkeypatch):
    check_memory(1 << 60)
    with pytest.raises(StorageError, match="memory limit"):
        check_memory(1)
    data = tmp_path / "a.csv"
    data.write_text(TEXT)
    settings = config.parse(CONFIG.format(path=data))
    seen = []

    def grows():
        seen.append(1)
        return 0 if len(seen) < 3 else 1 << 60

    monkeypatch.setattr(engine_module, "resident_bytes", grows)
    with pytest.raises(StorageError, match="memory limit"):  # passed before the load, and during or after it no more
        ingest(spark, settings), ingest(spark, settings)
    assert len(seen) >= 3


def test_engine_reload_and_http(spark, tmp_path):
    data, conf = tmp_path / "a.csv", tmp_path / "c.toml"
    data.write_text(TEXT)
    conf.write_text(CONFIG.format(path=data))
    loader = Loader(spark, config.load(str(conf)))
    engine = Engine(spark, loader.settings, first(loader))
    assert loader.reload() is None  # unchanged
    found = engine.query({"ranges": {"well": {"gte": 72}}})
    assert found == {"matched_rows": 2, "numeric": {"depth": {"count": 2, "sum": 1364.75, "min": 64.0, "max": 1300.75}, "drilled": {"count": 2, "oldest": "2019-07-04T05:00:00+00:00", "newest": "2020-02-29T12:00:00+00:00"}}, "string_counts": {"rock": {"chalk": 1, "gneiss": 1}}}
    assert engine.query({"must": {"rock": ["slate"]}}) == {"matched_rows": 0, "numeric": {"depth": {"count": 0, "sum": 0.0}, "drilled": {"count": 0}}}
    with pytest.raises(QueryError):
        engine.query({"must": {"well": ["x"]}})

    watcher = Watcher(engine, loader, str(conf))
    old = engine.snapshot
    data.write_text(TEXT + "x,1,loam,south,2019-07-04T05:00:00Z\n")
    os.utime(data, ns=(1, 1))
    assert not watcher.tick() and engine.snapshot is old  # a bad file leaves the old data
    data.write_text(TEXT + "78,1,loam,south,2019-07-04T05:00:00Z\n")
    os.utime(data, ns=(2, 2))
    with old.used():
        assert watcher.tick() and engine.snapshot.rows == 4 and old.df.is_cached  # a running query keeps its snapshot
    assert not old.df.is_cached
    conf.write_text(CONFIG.format(path=data).replace("string_value_counts = true", "string_value_counts = false"))
    os.utime(conf, ns=(3, 3))
    assert watcher.tick() and "string_counts" not in engine.query({})

    server = http.serve(engine, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(raw, kind="application/json"):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base}/query", raw, {"Content-Type": kind} if kind else {})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert post(b"{}") == (200, engine.query({}))
        assert [post(*x)[0] for x in ((b"{",), (b'{"x": 1}',), (b'{"must": {"no": []}}',), (b"{}", "text/plain"), (b'{"ranges": {"depth": {"gt": "x"}}}',))] == [400, 422, 400, 415, 400]
        status = json.load(urllib.request.urlopen(f"{base}/status"))
        assert status["rows_loaded"] == 4 and status["errors"]["last_24h"] == 3 and set(status) == {"uptime_secs", "rows_loaded", "queries", "errors"}
        assert "/query" in json.load(urllib.request.urlopen(f"{base}/docs.json"))["paths"]
    finally:
        server.shutdown()
        server.server_close()
    time.sleep(0)
    assert issubclass(QueryError, EngineError)
