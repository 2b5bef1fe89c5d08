"""Run registered queries against their SQL on DuckDB: python check_queries.py [sf_dir] [name …]."""

from __future__ import annotations

import os
import sys
import threading
import time

import duckdb
import pandas as pd

from fabtrail.catalog import ORACLE, QUERIES
from fabtrail.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

LIMIT_SECONDS = int(os.environ.get("CHECK_LIMIT", "40"))


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    shown = []
    for row in frame.itertuples(index=False):
        cells = []
        for value in row:
            if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
                cells.append("∅")
            elif isinstance(value, float):
                cells.append(f"{value:.9g}")
            elif hasattr(value, "tolist"):
                cells.append(str(value.tolist()))
            elif isinstance(value, pd.Timestamp):
                cells.append(value.isoformat())
            else:
                cells.append(str(value))
        shown.append(tuple(cells))
    return sorted(shown)


def compare(spark, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in ORACLE:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    started = time.time()
    want = connection.execute(ORACLE[name]).df()
    took_sql = time.time() - started
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    left, right = canonical(got), canonical(want)
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        missing = [r for r in right if r not in set(left)][:2]
        return False, f"{len(left)} rows vs {len(right)}\n   only here: {extra}\n   only SQL:  {missing}"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if got[c].dtype != want[c].dtype}
    return True, f"{len(left)} rows, {took:.1f}s, SQL {took_sql:.1f}s" + (f" types {types}" if types else "")


def stop(spark, connection) -> None:
    spark.sparkContext.cancelAllJobs()
    connection.interrupt()


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    failed = []
    for name in names:
        # a query that runs too long is stopped and counts as failed
        timer = threading.Timer(LIMIT_SECONDS, stop, (spark, connection))
        timer.start()
        try:
            ok, note = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        finally:
            timer.cancel()
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
