"""Run registered queries in Spark and their oracles in DuckDB and compare the rows.

usage: python tools/check_oracle.py [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.catalog import registry  # noqa: E402
from tickloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(canon(r[i]) for i in at) for r in con.fetchall())


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = 0
    for name, q in registry().items():
        if args.names and name not in args.names:
            continue
        if args.module and not q.build.__module__.endswith("." + args.module):
            continue
        start = time.time()
        try:
            df = q.build(spark, folder)
            if args.explain:
                df.explain("formatted")
            cols, rows = spark_rows(df)
            took = time.time() - start
            if q.oracle is None:
                print(f"ROWS {name}: {len(rows)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            dcols, drows = duck_rows(con, q.oracle)
            dtook = time.time() - start
            if cols != dcols:
                bad += 1
                print(f"FAIL {name}: columns {cols} vs {dcols}", flush=True)
            elif rows != drows:
                bad += 1
                left, right = set(rows) - set(drows), set(drows) - set(rows)
                print(f"FAIL {name}: {len(rows)} vs {len(drows)} rows; {len(left)}/{len(right)} differ; {cols}", flush=True)
                for r in sorted(left)[:3]:
                    print("   spark", r)
                for r in sorted(right)[:3]:
                    print("   duck ", r)
            else:
                flag = "" if rows else "  (EMPTY)"
                print(f"OK   {name}: {len(rows)} rows spark {took:.1f}s duck {dtook:.1f}s{flag}", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            text = str(exc).strip().splitlines()
            print(f"ERR  {name}: {type(exc).__name__} {' '.join(text[:3])[:600]}", flush=True)
            if os.environ.get("TB"):
                traceback.print_exc()
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
