"""Compare registered Spark jobs with their DuckDB oracle SQL (as the driver does).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]


def main():
    import duckdb

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from clusterscope.session import build_session

    spark = build_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    jobs = E.queries()
    sql = E.oracle_sql()
    bad = 0
    for name in names or list(jobs):
        t0 = time.time()
        df = jobs[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sql:
            print(f"{name:32s} spark rows={len(rows):7d} ({t1 - t0:5.1f}s)  [no oracle]")
            continue
        types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql[name]}").fetchall()}
        sp = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        tdiff = {f.name: (f.dataType.simpleString(), types.get(f.name)) for f in df.schema.fields
                 if sp.get(f.dataType.simpleString(), f.dataType.simpleString()) != types.get(f.name)}
        res = con.execute(sql[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        t2 = time.time()
        ok_cols = sorted(df.columns) == sorted(ocols)
        hs, ho = digest(df.columns, rows), digest(ocols, orows)
        ok = ok_cols and not tdiff and len(rows) == len(orows) and hs == ho
        bad += not ok
        print(f"{name:32s} spark rows={len(rows):7d} ({t1 - t0:5.1f}s) oracle rows={len(orows):7d} "
              f"({t2 - t1:5.1f}s) cols={'ok' if ok_cols else 'DIFF'} hash={'MATCH' if hs == ho else 'DIFF'}")
        if not ok_cols:
            print("   spark:", sorted(df.columns), "\n   oracle:", sorted(ocols))
        if tdiff:
            print("   types differ:", tdiff)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
