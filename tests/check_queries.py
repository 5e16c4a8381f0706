"""Run registered queries next to their SQL and compare the rows.

Usage: python tests/check_queries.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from voxlake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if hasattr(v, "tolist") and not isinstance(v, str):
            v = v.tolist()
        if isinstance(v, bool):
            return str(v)
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if isinstance(v, (int, float)):
            return f"{float(v):.10g}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    mine = fn(spark, sf_dir).toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns differ: {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    kinds = {
        c: (str(mine[c].dtype), str(theirs[c].dtype))
        for c in mine.columns
        if str(mine[c].dtype) != str(theirs[c].dtype)
    }
    return f"ok {len(a)} rows" + (f" types {kinds}" if kinds else "")


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("check", 8)
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                verdict = f"ok {fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as exc:  # noqa: BLE001
            verdict = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not verdict.startswith("ok")
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
