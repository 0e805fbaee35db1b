"""Run queries on Spark and their SQL on DuckDB over one folder of tables, and compare row by row.

usage: python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(values):
    """Kind of the first value of each column that has one."""
    return [next((type(r[i]).__name__ for r in values if r[i] is not None), None) for i in range(len(values[0]) if values else 0)]


def compare(spark, con, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLE:
        return f"{name:26s} rows-only {len(rows):8d} {spent:6.2f}s"
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"{name:26s} COLUMNS {sorted(df.columns)} != {sorted(names)}"
    mine, theirs = dict(zip(df.columns, kinds(rows))), dict(zip(names, kinds(want)))
    if mine != theirs:
        return f"{name:26s} TYPES {mine} != {theirs}"
    a, b = bag(df.columns, rows), bag(names, want)
    if a != b:
        return f"{name:26s} DIFF spark {len(rows)} oracle {len(want)}; only spark {list((a - b).items())[:3]} only oracle {list((b - a).items())[:3]}"
    return f"{name:26s} ok {len(rows):8d} {spent:6.2f}s"


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names:
        try:
            print(compare(spark, con, name, folder), flush=True)
        except Exception as e:
            print(f"{name:26s} FAIL {type(e).__name__} {str(e)[:500]}", flush=True)


if __name__ == "__main__":
    main()
