"""Compare registered queries with their DuckDB text: python tools/check.py [names] [--sf DIR]."""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tallyfield.plans import load_all  # noqa: E402
from tallyfield.session import build_session  # noqa: E402


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", action="append", default=[])
    ap.add_argument("--explain", action="store_true")
    a = ap.parse_args()
    queries, oracles = load_all()
    names = a.names or list(queries)
    if a.module:
        names = [n for n in queries if queries[n].__module__.split(".")[-1] in a.module]
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{a.sf}/*.parquet"):
        t = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, a.sf)
            if a.explain:
                df.explain("formatted")
            got = df.collect()
        except Exception as exc:
            bad += 1
            print(f"FAIL {n}: spark: {str(exc)[:1500]}")
            if not str(exc):
                traceback.print_exc()
            continue
        dt = time.time() - t0
        if n not in oracles:
            print(f"rows {n}: {len(got)} rows, {dt:.2f} s (no SQL)", got[0] if got else None)
            if not got:
                bad += 1
            continue
        t0 = time.time()
        try:
            cur = con.execute(oracles[n])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as exc:
            bad += 1
            print(f"FAIL {n}: sql: {str(exc)[:1200]}")
            continue
        do = time.time() - t0
        g, w = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols):
            bad += 1
            print(f"FAIL {n}: columns {sorted(df.columns)} != {sorted(cols)}")
        elif g != w:
            bad += 1
            print(f"FAIL {n}: {len(g)} rows vs {len(w)}")
            print("   columns", sorted(cols))
            gs, ws = set(g), set(w)
            print("   spark only", sorted(gs - ws)[:4])
            print("   sql only  ", sorted(ws - gs)[:4])
        else:
            odd = []
            for c, t in df.dtypes:
                d = types[c]
                ok = {
                    "bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",),
                    "string": ("VARCHAR",), "boolean": ("BOOLEAN",),
                }.get(t)
                if ok and d not in ok:
                    odd.append(f"{c}:{t}/{d}")
            empty = " EMPTY" if not g else ""
            print(f"ok   {n}: {len(g)} rows, {dt:.2f} s, sql {do:.2f} s {' '.join(odd)}{empty}")
            if empty:
                bad += 1
    print(f"{len(names)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
