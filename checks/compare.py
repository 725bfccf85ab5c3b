"""Run every query next to its SQL counterpart and compare the rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracles, registry
from sourcelore.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(file))[0]
        connection.execute(f"create view {name} as select * from '{file}'")
    return connection


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, connection: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """An empty text when both sides agree, else what differs."""
    frame = registry.build()[name](spark, sf_dir)
    ours = _rows(frame.columns, frame.collect())
    statement = oracles.build().get(name)
    if statement is None:
        return f"no SQL, {len(ours)} rows"
    cursor = connection.execute(statement)
    columns = [c[0] for c in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if ours == theirs:
        types = {type(v).__name__ for row in ours[:50] for v in row}, {type(v).__name__ for row in theirs[:50] for v in row}
        return "" if types[0] == types[1] else f"types {types}"
    mine, other = set(ours), set(theirs)
    only = lambda a, b: sorted(a - b, key=repr)[:3]
    return f"{len(ours)} rows against {len(theirs)}; only here {only(mine, other)}; only there {only(other, mine)}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(registry.build())
    spark = local_session(os.cpu_count() or 4)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem}", flush=True)


if __name__ == "__main__":
    main()
