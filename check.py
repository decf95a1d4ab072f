"""Run registered queries next to their DuckDB counterparts and compare the rows.

    python check.py [--sf /root/testdata/sf0.01] [name or prefix* ...]
"""

from __future__ import annotations

import argparse
import fnmatch
import math
import sys
import time
import traceback

import duckdb

from merchlens.plans import registry
from merchlens.session import build_session, scratch_scope

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    try:
        return f"{float(value):.6f}" if not float(value).is_integer() else str(int(value))
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(canonical(r[i]) for i in order) for r in rows])


def compare(name, spark, con, sf):
    start = time.time()
    df = registry.QUERIES[name](spark, sf)
    spark_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    cols, got = rows_of(df.columns, spark_rows)
    if name not in registry.ORACLES:
        return f"rows {len(got)}", took, True
    start = time.time()
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want_cols, want = rows_of(names, cursor.fetchall())
    duck = time.time() - start
    if cols != want_cols:
        return f"COLUMNS {cols} != {want_cols}", took, False
    if got == want:
        return f"ok {len(got)} (duckdb {duck:.1f}s)", took, True
    missing = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    clip = lambda rs: [tuple(v[:300] for v in r) for r in rs]
    return f"DIFF got={len(got)} want={len(want)}\n    only duckdb: {clip(missing)}\n    only spark:  {clip(extra)}", took, False


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--module", help="only queries of one plan module")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    registry.load_all()
    names = [n for n, q in registry.QUERIES.items() if not args.module or q.__module__.endswith("." + args.module)]
    names = [n for n in names if not args.names or any(fnmatch.fnmatch(n, p) for p in args.names)]
    spark = build_session("check", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for name in names:
        try:
            with scratch_scope(spark):
                message, took, good = compare(name, spark, con, args.sf)
        except Exception as error:  # report and go on with the next query
            message, took, good = f"ERROR {type(error).__name__}: {str(error)[:900]}", 0.0, False
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{name:32s} {took:6.2f}s  {message}", flush=True)
        if not good:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
