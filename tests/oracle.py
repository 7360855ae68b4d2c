"""Compare a query's rows with its SQL on the same tables, in any order, names and values alike."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns: list[str], values: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


def compare(spark, query, sql: str, folder: str = FOLDER) -> None:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected.fetchall())
