"""Run registered queries next to their DuckDB statement: python -m tests.compare [names...] [--sf DIR]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        if math.isnan(f):
            return "NaN"
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f)
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows-only {len(got[1])}"
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, f"{len(got[1])} vs {len(want[1])} rows; cols {got[0]}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}"


def main(argv):
    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        folder = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    from tracelake.catalog import ORACLES, QUERIES
    from tracelake.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in [n for n in QUERIES if not argv or n in argv]:
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, folder, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
