"""Run registered queries against their SQL counterparts: ``python check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

from tidemark.catalog import load
from tidemark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canon(columns, rows):
    """Column names, and every row as text, in an order that no engine decides."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return repr(v) if v != int(v) or abs(v) > 1e15 else f"{v:.1f}"
        return str(v)

    return [columns[i] for i in at], sorted("\x1f".join(cell(r[i]) for i in at) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if not sql:
        return took, len(rows), "rows-only"
    t1 = time.time()
    cur = con.execute(sql)
    expect = cur.fetchall()
    names = [d[0] for d in cur.description]
    a, b = canon(df.columns, rows), canon(names, expect)
    digest = hashlib.sha256("\n".join(a[1]).encode()).hexdigest()[:8]
    note = f"sql {time.time() - t1:.1f}s"
    if a[0] != b[0]:
        return took, len(rows), f"COLUMNS {a[0]} != {b[0]}"
    if a[1] != b[1]:
        only_a, only_b = sorted(set(a[1]) - set(b[1]))[:3], sorted(set(b[1]) - set(a[1]))[:3]
        return took, len(rows), f"DIFF spark={len(a[1])} sql={len(b[1])}\n   spark {[x.split(chr(31)) for x in only_a]}\n   sql   {[x.split(chr(31)) for x in only_b]}\n   cols {a[0]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    other = {d[0]: str(d[1]) for d in cur.description}
    odd = {n: (types[n], other[n]) for n in types if (types[n], other[n].upper()) not in OK}
    return took, len(rows), f"ok {digest} {note}" + (f" TYPES {odd}" if odd else "")


OK = {
    ("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
    ("float", "FLOAT"), ("smallint", "SMALLINT"),
}


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    picked = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name in picked:
        try:
            took, n, note = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            took, n, note = 0, -1, f"ERROR {type(exc).__name__} {str(exc)[:900]}"
        bad += not (note.startswith("ok") or note == "rows-only")
        print(f"{name:34s} {took:6.2f}s {n:7d} rows  {note}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
