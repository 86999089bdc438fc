"""Run queries and their SQL side by side and compare them value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if isinstance(value, (bool, str)):
        return str(value)
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, connection, query, sql: str, sf_dir: str) -> str:
    """Empty when both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return ""
    extra = sorted(set(got) - set(want))[:2]
    missing = sorted(set(want) - set(got))[:2]
    return f"{len(got)} vs {len(want)} rows\n   columns {sorted(columns)}\n   only spark {extra}\n   only sql   {missing}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from conftest import session

    sf = sys.argv[1]
    spark = session()
    connection = connect(sf)
    queries, oracles = contract.queries(), contract.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, connection, queries[name], oracles[name], sf)
            else:
                found = f"no SQL, {queries[name](spark, sf).count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not found else 'BAD '} {name} {time.time() - start:.1f}s {found}", flush=True)
    print("without query:", sorted(set(oracles) - set(queries)))
