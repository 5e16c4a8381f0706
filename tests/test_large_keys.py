"""Queries on keys beyond those of the test tables, next to their SQL."""

import duckdb
from check_queries import compare

import __spark_entry__ as entry


def test_file_names_of_six_digit_cases(spark, tmp_path):
    parts = "id + 99990 AS p_partkey", "CAST(1 + id % 50 AS INT) AS p_size"
    spark.range(60).selectExpr(*parts).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    name = "s7_discover_files"
    found = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert found.startswith("ok 90 rows"), found
