"""Run registered queries and compare each with its check SQL in DuckDB.

    python tests/compare.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("itemspark")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v) + 0.0)
        return str(v)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def check(spark, con, name, folder):
    """None when equal (or unchecked), else a short description of the difference."""
    from itemspark.catalog import ORACLES, QUERIES
    df = QUERIES[name](spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        return None if got else "no rows", len(got)
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    want = canonical(answer.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(got)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{len(got)} rows against {len(want)}; first differences {diff}", len(got)
    return (None if got else "no rows"), len(got)


def main():
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.001"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    from itemspark.catalog import ORACLES, QUERIES
    spark, con = session(), duck(folder)
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            problem, n = check(spark, con, name, folder)
        except Exception as error:      # report and go on with the other queries
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{mark:4}{kind:5}{time.time() - start:6.2f}s {n:8} {name} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
