"""Runs registered queries against their DuckDB statements: ``python tests/compare.py [sf] [names...]``."""
from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def norm(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, name, q, sql):
    t = time.time()
    df = q(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    if sql is None:
        return f"rows-only {len(got)} rows", spent, True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(cols, want)
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}", spent, False
    if a[1] != b[1]:
        only_a = [r for r in a[1] if r not in set(b[1])][:2] if len(a[1]) < 20000 else "..."
        only_b = [r for r in b[1] if r not in set(a[1])][:2] if len(b[1]) < 20000 else "..."
        return f"rows {len(a[1])} vs {len(b[1])}: {only_a} | {only_b}", spent, False
    return f"ok {len(got)} rows", spent, True


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from talkweave.session import build_session
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, orc, bad = duck(sf_dir), oracle_sql(), 0
    for name, q in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            msg, spent, ok = compare(spark, con, sf_dir, name, q, orc.get(name))
        except Exception as e:                                   # report and go on
            msg, spent, ok = f"{type(e).__name__}: {str(e)[:400]}", 0.0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:28s} {spent:6.2f}s {msg}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
