"""Compare registered queries with their SQL counterparts: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from variscope.catalog import load
from variscope.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def check(spark, con, name, entry, sf_dir):
    started = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - started
    if entry.sql is None:
        return "rows-only", len(got), took, ""
    cursor = con.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    types = sorted({type(v).__name__ for row in got for v in row} ^ {type(v).__name__ for row in want for v in row})
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return "MISMATCH", len(got), took, f"{len(a)} vs {len(b)} {sorted(names)}\n   spark {only[0]}\n   duckdb {only[1]}"
    note = f"types differ {types}" if types else ""
    return ("ok" if got else "EMPTY"), len(got), took, note


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    entries = load()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in entries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            status, n, took, note = check(spark, con, name, entry, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            text = traceback.format_exc() if len(wanted) == 1 else str(e)
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {text[:1500]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:32} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print(f"{bad} not ok")


if __name__ == "__main__":
    main()
