"""Runs named queries and their SQL on the same tables and reports differences.

    python tests/compare.py [--sf 0.01] [--plans] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, dict):
        return tuple(sorted((k, canonical(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return (type(v).__name__, v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([canonical(r[i]) for i in order]) for r in rows))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if not sql:
        return f"rows {len(got)}", took, True
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if time.time() - start > 10:
        print(f"  slow oracle: {name} {time.time() - start:.1f}s", flush=True)
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(columns)}", took, False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"ok {len(a)} rows", took, True
    sa, sb = set(a), set(b)
    example = (sorted(sa - sb)[:2], sorted(sb - sa)[:2])
    return (f"DIFF {len(a)} vs {len(b)} rows, {len(sa - sb)}/{len(sb - sa)} differ\n"
            f"  {sorted(df.columns)}\n  spark {example[0]}\n  sql   {example[1]}"), took, False


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    from cohortmill.plans.registry import ORACLES, QUERIES
    from cohortmill.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    names = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    for name in names:
        try:
            text, took, good = check(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:  # noqa: BLE001
            text, took, good = "ERROR " + str(exc)[:1500], 0.0, False
        print(f"{name}: {text} ({took:.2f}s)", flush=True)
        if not good:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} fine; bad: {bad}")


if __name__ == "__main__":
    main()
