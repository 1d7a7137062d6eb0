"""Holds a query's rows against those of its SQL.

As a script: python -m tests.compare SF_DIR [NAME...] runs queries of __spark_entry__ one after the other.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value as both engines give it."""
    if x is None:
        return None
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return x
    if isinstance(x, str):
        return x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return float(f"{float(x):.9g}") if hasattr(x, "as_tuple") else str(x)


def rows_of_spark(df) -> tuple[list[str], Counter]:
    t = df.toArrow()
    names = sorted(t.column_names)
    return names, Counter(tuple(plain(v) for v in r) for r in zip(*(t[c].to_pylist() for c in names)))


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.sql(sql)
    t = out.to_arrow_table() if hasattr(out, "to_arrow_table") else out.arrow()
    t = t.read_all() if hasattr(t, "read_all") else t
    names = sorted(t.column_names)
    return names, Counter(tuple(plain(v) for v in r) for r in zip(*(t[c].to_pylist() for c in names)))


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs, or ''."""
    (a, x), (b, y) = rows_of_spark(df), rows_of_sql(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return "" if x else "no rows"
    return f"{x.total()} and {y.total()} rows; only in Spark {list((x - y).items())[:3]}, only in SQL {list((y - x).items())[:3]}"[:3000]


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master(f"local[{os.environ.get('COMPARE_CPUS', '4')}]").config(map={"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, sql[name], sf_dir) if name in sql else f"rows only: {df.count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
