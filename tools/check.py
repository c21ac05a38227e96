"""Run registered queries against their check SQL in DuckDB.

usage: python tools/check.py [-d folder] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from larder import build_session  # noqa: E402
from larder.plans.registry import TABLES, load_all  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_columns, spark_rows, duck_columns, duck_rows) -> str:
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns differ: {sorted(spark_columns)} / {sorted(duck_columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"row count differs: {len(spark_rows)} / {len(duck_rows)}"
    a, b = rows_of(spark_columns, spark_rows), rows_of(duck_columns, duck_rows)
    if a != b:
        first = next((x, y) for x, y in zip(a, b) if x != y)
        return f"values differ ({sorted(spark_columns)}): {str(first[0])[:400]} / {str(first[1])[:400]}"
    return ""


def connect(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = load_all()
    db = connect(args.d)
    bad = 0
    for name in queries:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        print(f"...  {name}", end=" ", flush=True)
        try:
            df = queries[name](spark, args.d)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name in checks:
                cur = db.execute(checks[name])
                names = [c[0] for c in cur.description]
                t2 = time.time()
                problem = compare(df.columns, rows, names, cur.fetchall())
                slow = f" check {time.time() - t2:.1f}s" if time.time() - t2 > 5 else ""
            else:
                problem, slow = "", " (no check)"
            print(f"{'FAIL' if problem else 'ok  '} {name} {len(rows)} rows {took:.1f}s{slow} {problem}", flush=True)
            bad += bool(problem)
        except Exception as e:  # noqa: BLE001
            bad += 1
            text = str(e).strip().split("\n")[0][:500]
            where = traceback.extract_tb(e.__traceback__)
            mine = [f"{Path(f.filename).name}:{f.lineno}" for f in where if "/repo/" in f.filename][-3:]
            print(f"FAIL {name} error {type(e).__name__}: {text} @ {mine}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
