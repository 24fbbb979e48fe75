"""Queries over documents with empty, blank and missing texts give the rows of their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = ["", " ", None, "plain", "see http://a.example", "https://b.example", "\n", "é" * 600]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = " UNION ALL ".join(
        f"SELECT {i}::BIGINT + r * {len(TEXTS)} AS doc_id, {'NULL' if t is None else chr(39) + t + chr(39)}::VARCHAR AS text FROM range(21) x(r)"
        for i, t in enumerate(TEXTS)
    )
    duckdb.sql(f"COPY ({rows}) TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path)


def rows_of(spark, folder, name):
    got = sorted(map(repr, (tuple(r) for r in entry.queries()[name](spark, folder).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return got, sorted(map(repr, con.sql(entry.oracle_sql()[name]).fetchall()))


def test_automation_rules(spark, folder):
    got, want = rows_of(spark, folder, "p18_automation_rules")
    assert got == want


def test_post_rows(spark, folder):
    got, want = rows_of(spark, folder, "s21_post_rows")
    assert got == want
