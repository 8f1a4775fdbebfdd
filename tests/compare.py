"""Runs queries against their SQL and reports differences."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def cell(x):
        return None if x is None or x != x else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows):
    return [sorted({type(x).__name__ for x in col if x is not None}) for col in zip(*rows)]


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else a description."""
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got == want:
        return None if kinds(got) == kinds(want) else f"types {kinds(got)} != {kinds(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {sorted(names)}: {bad[0][0]} != {bad[0][1]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tests.session import session

    sf = sys.argv[1]
    spark, con = session(), connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            msg = compare(spark, con, n, qs[n], sqls[n], sf) if n in sqls else "no SQL"
        except Exception as x:                                   # report and go on
            msg = f"ERROR {str(x)[:600]}"
        if msg:
            failed += msg != "no SQL"
            print(f"{n:24s} {time.time() - t:6.2f} {msg[:900]}", flush=True)
    print("failed", failed, "of", len(qs))
