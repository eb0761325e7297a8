"""Compare registered queries with their SQL counterparts in DuckDB: ``python tests/check_queries.py [sf] [name...]``."""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.12g}")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(folder, names):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    oracles, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            columns, got = rows_of(df.columns, df.collect())
        except Exception as error:
            bad += 1
            print("FAIL", name, str(error)[:600], flush=True)
            continue
        seconds = time.time() - started
        if name not in oracles:
            print(f"rows {name} {len(got)} {seconds:.1f}s", flush=True)
            continue
        try:
            cursor = con.execute(oracles[name])
            want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as error:
            bad += 1
            print("ORACLE", name, str(error)[:400], flush=True)
            continue
        if columns != want_columns or got != want:
            bad += 1
            first = next(((g, w) for g, w in zip(got, want) if g != w), None)
            print("DIFF", name, len(got), len(want), columns == want_columns or (columns, want_columns), str(first)[:700], flush=True)
        else:
            print(f"ok {name} {len(got)} {seconds:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sys.exit(1 if main(f"/root/testdata/{sf}", sys.argv[2:]) else 0)
