"""Run registered queries beside their SQL in DuckDB: python -m tests.compare DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return value


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows(names, cur.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, df.collect())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    base, only = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(base)
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            mine = spark_rows(q(spark, base))
            took = time.time() - t
            if name not in entry.oracle_sql():
                print(f"{name}: {len(mine[1])} rows, no SQL, {took:.1f} s")
                continue
            t = time.time()
            theirs = sql_rows(con, entry.oracle_sql()[name])
            same = mine == theirs
            print(f"{name}: {'ok' if same else 'DIFFERENT'} {len(mine[1])} rows, {took:.1f} s, SQL {time.time() - t:.1f} s")
            if not same:
                a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
                print("   ", mine[0], theirs[0], len(theirs[1]), "\n    only Spark:", list(a - b)[:3], "\n    only SQL:", list(b - a)[:3])
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:600]}")
