"""Compare every registered query with its SQL: ``python tests/check.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in at) for r in rows)


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return sum(got.values()) > 0, f"{sum(got.values())} rows, no SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        return False, (
            f"{sum(got.values())} rows against {sum(want.values())};"
            f" only Spark {str(list((got - want).items())[:2])[:600]};"
            f" only SQL {str(list((want - got).items())[:2])[:600]}"
        )
    return True, f"{sum(got.values())} rows"


def main() -> None:
    from textprep.session import build_session

    sf, *names = sys.argv[1:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name in names or entry.queries():
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
