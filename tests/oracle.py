"""Compare registered queries with their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from inkgate.catalog.bindings import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def main() -> None:
    import __spark_entry__ as contract
    from inkgate.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session(
        "oracle",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in names:
        try:
            start = time.time()
            cols, got = spark_rows(contract.queries()[name](spark, folder))
            took = time.time() - start
            if name not in contract.oracle_sql():
                print(f"{name:28} rows {sum(got.values()):7} {took:6.1f}s  (no SQL)", flush=True)
                continue
            start = time.time()
            want_cols, want = sql_rows(con, contract.oracle_sql()[name])
            sql_took = time.time() - start
            same = cols == want_cols and got == want
            print(
                f"{name:28} {'ok ' if same else 'BAD'} rows {sum(got.values()):7}"
                f" {took:6.1f}s  sql {sql_took:6.1f}s",
                flush=True,
            )
            if not same:
                bad.append(name)
                print("   columns", cols, want_cols)
                print("   only here ", list((got - want).items())[:2])
                print("   only SQL  ", list((want - got).items())[:2])
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"{name:28} ERROR {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failed:", bad or "none")
    spark.stop()


if __name__ == "__main__":
    main()
