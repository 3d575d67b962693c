import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given texts, doc_id from 0, in three parts, with columns whose names clash with the operators' own."""

    def make(texts, ids=None):
        rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA + ", score string, k long, kept long").repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest test table."""
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


ODD = [None, "", " \t\n", "a", "a", "A", "é" * 300, "word " * 4000, "x" * 70000, "one two three four five six", "one two three four five six", " ", "🙂 ok\r\nfine", "0" * 30]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
