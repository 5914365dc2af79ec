"""Run registered queries on Spark and their SQL on DuckDB, and compare.

    python -m tests.compare [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)} rows", took, 0.0, len(got) > 0
    t0 = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    dtook = time.time() - t0
    dcols = [(c[0], str(c[1])) for c in cur.description]
    scols = [(f.name, f.dataType.simpleString()) for f in df.schema]
    notes = []
    if sorted(c for c, _ in dcols) != sorted(c for c, _ in scols):
        return f"COLUMNS differ spark={scols} duck={dcols}", took, dtook, False
    types = dict(dcols)
    for c, kind in scols:
        if KIND.get(kind, kind) != types[c]:
            notes.append(f"type {c}: {kind} vs {types[c]}")
    a, b = bag([c for c, _ in scols], got), bag([c for c, _ in dcols], want)
    if a != b:
        names = sorted(c for c, _ in scols)
        return (
            f"VALUES differ rows {len(got)} vs {len(want)} {notes}\n   {names}\n   only spark {list((a - b).items())[:2]}\n   only duck  {list((b - a).items())[:2]}",
            took, dtook, False,
        )
    return f"{len(got)} rows {'; '.join(notes)}", took, dtook, not notes and len(got) > 0


def main(argv):
    from parley.catalog import ORACLES, QUERIES
    from parley.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            msg, took, dtook, ok = compare(spark, con, name, fn, ORACLES.get(name), folder)
        except Exception as e:  # noqa: BLE001
            msg, took, dtook, ok = f"ERROR {type(e).__name__}: {str(e)[:900]}", 0, 0, False
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {took:6.2f}s duck {dtook:5.2f}s {msg}", flush=True)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
