"""Compare a registered query with its SQL on the same Parquet tables.

Also a command: ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"columns {sorted(columns)}: {str(g)[:600]} != {str(w)[:600]}"
    if not got:
        return "no rows on either side"
    return None


def main(argv):
    import __spark_entry__ as entry
    from threadloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, connect(sf_dir), sf_dir, name, queries[name], oracles[name])
            else:
                result = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        kind = "D" if name in oracles else "R"
        print(f"{name:28s} {kind} {time.time() - start:6.1f}s {'ok' if result is None else 'FAIL ' + result}",
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
