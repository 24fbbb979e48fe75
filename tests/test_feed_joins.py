"""The feed's stages give the rows of their SQL where rejections are too many to broadcast."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["a08_stage_counts", "u01_tier_union"])
def test_like_sql(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        got = sorted(map(tuple, entry.queries()[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
