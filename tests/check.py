"""Run registered queries next to their SQL on one data folder and compare the rows.

    python tests/check.py [sf_dir] [name …]

With CHECK_ROWS=n segments hold n rows, so that even short sessions take several.
"""

import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6f}" if value != int(value) else str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return f"rows {len(got[1])}", spent, len(got[1]) > 0
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", spent, False
    if got[1] != want[1]:
        here, there = set(got[1]), set(want[1])
        extra = [r for r in got[1] if r not in there][:3]
        lacking = [r for r in want[1] if r not in here][:3]
        return f"{len(got[1])} vs {len(want[1])} rows; only here {extra}; only there {lacking}", spent, False
    return f"ok {len(got[1])}", spent, len(got[1]) > 0


def session(cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark, con = session(), oracle(sf)
    bad = 0
    for name in names:
        try:
            note, spent, good = compare(spark, con, sf, name, e.queries()[name], e.oracle_sql().get(name))
        except Exception as err:
            note, spent, good = f"{type(err).__name__}: {str(err)[:700]}", 0.0, False
            if len(names) == 1:
                traceback.print_exc()
        bad += not good
        print(f"{'OK ' if good else 'BAD'} {spent:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
