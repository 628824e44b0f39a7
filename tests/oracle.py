"""Compare registered queries with their SQL twins on DuckDB.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as E  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    """(problem or None, row count, Spark seconds)."""
    start = time.time()
    df = E.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    sql = E.oracle_sql().get(name)
    if sql is None:
        return (None if got else "no rows"), len(got), took
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"{len(bad)} differ, columns {sorted(names)}: {bad[:2]}" if bad else None), len(got), took


if __name__ == "__main__":
    from conftest import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(E.queries())
    spark, con, failed = build_session(), connect(sf), 0
    for n in wanted:
        try:
            problem, count, took = compare(spark, con, n, sf)
        except Exception as exc:  # report and go on with the next query
            problem, count, took = f"{type(exc).__name__}: {str(exc)[:600]}", 0, 0.0
        failed += problem is not None
        kind = "sql" if n in E.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok'} {n} [{kind}] rows={count} {took:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
