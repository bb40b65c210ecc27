"""Run registered queries in Spark and their SQL in DuckDB, compare results
(row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return v.item()
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = sorted((tuple(_norm(x) for x in r) for r in res.fetchall()), key=repr)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns {s_cols} vs {d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ e.g. {diff}")
    return problems, len(s_rows)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from verdant.session import get_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in qs:
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sqls:
                problems, n = compare(spark, con, name, qs[name], sqls[name], sf_dir)
            else:
                n = qs[name](spark, sf_dir).count()
                problems = []
            status = "OK " if not problems else "BAD"
        except Exception as e:  # noqa: BLE001
            problems, n, status = [repr(e)[:600]], -1, "ERR"
        bad += status != "OK "
        print(f"{status} {name:28s} rows={n:<7} {time.time() - t:6.1f}s {'S' if name in sqls else 'R'} {'; '.join(problems)[:700]}", flush=True)
    print("failures:", bad)
