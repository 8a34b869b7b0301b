"""Run queries in Spark and their SQL twins in DuckDB and compare the rows.

    python -m parity.check [--dir FOLDER] [QUERY ...]
"""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path

import duckdb

from parity.oracle import oracle_sql
from waymark.plans.registry import queries
from waymark.session import local_session


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    body = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return named, body


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = queries()[name](spark, folder)
    left = rows_of(df.columns, df.collect())
    result = con.execute(oracle_sql()[name])
    right = rows_of([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])][:2] if len(left[1]) < 50_000 else []
        only_right = [r for r in right[1] if r not in set(left[1])][:2] if len(right[1]) < 50_000 else []
        return f"rows {len(left[1])} / {len(right[1])}; only spark {only_left}; only sql {only_right}"
    return None


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--dir", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    given = args.parse_args()
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = connect(given.dir)
    known = oracle_sql()
    bad = 0
    for name in given.names or queries():
        if name not in known:
            print(f"-- {name}: no SQL twin", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, given.dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        print(f"{'ok' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
