"""Compare queries with their SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(path):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} differ, e.g. {sorted(got_cols)}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return f"ok {len(got)}" if got else "EMPTY"


def main():
    from __spark_entry__ import oracle_sql, queries
    from loomlog.plans.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(path)
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not names or any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]
    if os.environ.get("ONLY_SQL"):
        names = [n for n in names if n in sqls]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                msg = compare(qs[n](spark, path), con, sqls[n])
            else:
                k = qs[n](spark, path).count()
                msg = f"ok rows-only {k}" if k else "EMPTY rows-only"
        except Exception as e:  # report and go on with the other queries
            msg = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if not msg.startswith("ok"):
            bad += 1
        print(f"{n:28s} {time.time() - t:5.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
