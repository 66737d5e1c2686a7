"""Runs queries on Spark and their SQL on DuckDB over the same tables and compares the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(0.0 if value == 0 else value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    """(problem or None, rows, seconds on Spark)"""
    started = time.monotonic()
    df = run(spark, sf_dir)
    ours = df.collect()
    seconds = time.monotonic() - started
    if sql is None:
        return (None if ours else "no rows"), len(ours), seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}", len(ours), seconds
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}", len(ours), seconds
    different = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if different:
        return f"{len(different)} rows differ in {a[0]}, first {different[0]}", len(ours), seconds
    return None, len(ours), seconds


def main():
    import __spark_entry__ as entry
    from tallyspark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--sql-only", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or (sql if args.sql_only else queries):
        try:
            problem, n, seconds = compare(spark, con, sf_dir, queries[name], sql.get(name))
        except Exception as error:  # a broken query must not hide the others
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        failed += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {n:8d} rows {seconds:7.2f} s {problem or ''}",
              flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
