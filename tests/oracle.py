"""Compare registered queries with their SQL in DuckDB.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "" if value is None else str(value)


def _rows(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def _kind(name: str) -> str:
    name = name.lower()
    return {"integer": "int", "varchar": "string", "hugeint": "int128"}.get(name, name)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, otherwise what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    kinds = [_kind(str(d[1])) for d in relation.description]
    expected = _rows(names, relation.fetchall())
    found_names = spark_df.columns
    if sorted(found_names) != sorted(names):
        return f"columns {sorted(found_names)} != {sorted(names)}"
    found = _rows(found_names, [tuple(r) for r in spark_df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)}"
    for a, b in zip(found, expected):
        if a != b:
            only_found = set(found) - set(expected)
            only_expected = set(expected) - set(found)
            return (
                f"{len(only_found)} rows differ, columns {sorted(names)}: "
                f"{sorted(only_found)[:2]} vs {sorted(only_expected)[:2]}"
            )
    spark_kinds = dict(spark_df.dtypes)
    odd = [
        (n, spark_kinds[n], k)
        for n, k in zip(names, kinds)
        if _kind(spark_kinds[n]) != k and not k.startswith("number")
    ]
    return f"types {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as driver
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    queries, oracle = driver.queries(), driver.oracle_sql()
    spark, con = make_session(), connect(sf_dir)
    failed = 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            result = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(result, con, oracle[name])
            else:
                problem = f"rows only: {result.count()}"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        if problem and not problem.startswith("rows only"):
            failed += 1
        print(f"{name:24s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
