"""Run named queries in Spark and their SQL in DuckDB on the same parquet
tables and compare row count, column names and the multiset of rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    ts = time.time() - t
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    sc, sm = rows_of(df.columns, s_rows)
    dc, dm = rows_of(d_cols, d_rows)
    ok = sc == dc and sm == dm
    msg = f"{'MATCH' if ok else 'DIFF '} {name}: spark {len(s_rows)} rows {ts:.1f}s, duckdb {len(d_rows)}"
    if not ok:
        if sc != dc:
            msg += f"\n   cols spark={sc}\n   cols duck ={dc}"
        only_s = list((sm - dm).elements())[:3]
        only_d = list((dm - sm).elements())[:3]
        msg += f"\n   only spark: {[str(x)[:400] for x in only_s]}\n   only duck:  {[str(x)[:400] for x in only_d]}"
        msg += f"\n   n only spark={sum((sm - dm).values())} n only duck={sum((dm - sm).values())}"
    return ok, msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from moodline.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"NOSQL {name}")
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"ERROR {name}: {type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
