"""The columns of operators that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from quernstone.llm import parts


def compared(spark, name, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want, got = c.sql(parts.SQL[name]), parts.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r[x] for x in columns) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())
    return want


@pytest.mark.parametrize("name", sorted(parts.QUERIES))
def test_parts(spark, name):
    assert len(compared(spark, name, "/root/testdata/sf0.001").fetchall()) > 0


@pytest.mark.parametrize("name", sorted(parts.QUERIES))
def test_parts_of_odd_texts(spark, docs_of, odd, tmp_path, name):
    texts = [
        *odd,
        "password = 'hunter22' token:abcdef api-key=short API_KEY=\"0123456789abcdef01234567\"",
        "ſecret=abcdefgh toKen=abcdefgh é🙂 secret:abcdefg",
        "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15 + " " + "ab12" * 6 + "g" + "ab12" * 5,
        "token=" + "f" * 30 + "\ntoken=AKIA" + "0" * 20,
    ]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"copy (select * from '{tmp_path}/documents.parquet/*.parquet') to '{tmp_path}/flat.parquet'")
    (tmp_path / "t").mkdir()
    (tmp_path / "flat.parquet").rename(tmp_path / "t" / "documents.parquet")
    assert len(compared(spark, name, str(tmp_path / "t")).fetchall()) == len(texts)
