"""Run registered queries next to their SQL and compare rows: ``check_catalog.py [sf] [name-prefix ...]``."""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from noviscan import get_session
from noviscan.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    root = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    spark = get_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, root)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name}: {len(got[1])} rows {took:.1f}s {got[1][:1]!s:.150}", flush=True)
                continue
            res = con.execute(ORACLE[name])
            want = rows_of([d[0] for d in res.description], res.fetchall())
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
            continue
        if got == want:
            print(f"ok    {name}: {len(got[1])} rows {took:.1f}s {'(EMPTY)' if not got[1] else ''}", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: {len(got[1])} vs {len(want[1])} rows, columns {got[0]} vs {want[0]}", flush=True)
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        for r in sorted(a - b)[:2]:
            print("   spark", r[:700])
        for r in sorted(b - a)[:2]:
            print("   sql  ", r[:700])
    print("bad:", bad)


if __name__ == "__main__":
    main()
