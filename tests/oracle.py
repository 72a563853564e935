"""Compares queries with their SQL on DuckDB: ``python tests/oracle.py [folder] [name …]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "as_tuple"):
        return f"decimal {v}"
    return f"{type(v).__name__} {v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    held = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(held, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows under the same columns."""
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected_columns, expected = rows_of(names, found.fetchall())
    if columns != expected_columns:
        return f"columns {columns} and {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} and {len(expected)} rows"
    for ours, theirs in zip(rows, expected):
        if ours != theirs:
            return f"{ours} and {theirs}"
    return None


def main() -> None:
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from conftest import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), connect(folder)
    wrong = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            found = f"no SQL, {df.count()} rows" if sql is None else difference(df, con, sql)
        except Exception as error:  # noqa: BLE001
            found = f"failed: {str(error)[:600]}"
        wrong += found is not None
        print(f"{name:28} {time.time() - start:6.2f}s  {found or 'same'}", flush=True)
    print(f"{wrong} of {len(names)} differ")


if __name__ == "__main__":
    main()
