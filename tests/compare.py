"""Runs queries beside their SQL and reports differences; used by the tests and by hand."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from emberwatch.plans.durable import name_local_folder
from emberwatch.queries.catalog import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b, strict=True))
    return a == b


def compare(spark: SparkSession, con, folder: str, name: str) -> str:
    """'exact', 'close' (last digits differ), 'rows only' or a description of the first difference."""
    df = queries()[name](spark, folder)
    got = [tuple(_from_row(v) for v in row) for row in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"DIFF columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"DIFF rows {len(a)} != {len(b)}"
    if a == b:
        types = {type(x) for row in a for x in row} ^ {type(x) for row in b for x in row}
        return f"exact {len(a)}" + (f" (types {types})" if types else "")
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    far = [(x, y) for x, y in wrong if not _close(x, y)]
    if not far:
        return f"close {len(wrong)} of {len(a)}"
    x, y = far[0]
    cells = [(n, p, q) for n, p, q in zip(sorted(names), x, y, strict=True) if not _close(p, q)]
    return f"DIFF {len(far)} of {len(a)} rows, first: {cells[:4]}"


def _from_row(value):
    from pyspark.sql import Row

    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, list):
        return [_from_row(v) for v in value]
    return value


def main(folder: str, *wanted: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    name_local_folder(spark).sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name in queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            result = compare(spark, con, folder, name)
        except Exception as error:  # keep going: one broken query must not hide the others
            result = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:36s} {time.time() - began:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
