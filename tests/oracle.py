"""Run registered queries in Spark and in DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [name ...] [+module ...]
"""

from __future__ import annotations

import importlib
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "NULL" if v is None else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return cols, cur.fetchall(), kinds


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def check(spark, con, sf_dir, query, sql):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    got = df.collect()
    cols, want, kinds = duck(con, sql)
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    off = [f"{n}: {t} / {kinds[n]}" for n, t in df.dtypes if KIND.get(t, "?") != kinds[n]]
    if off:
        return f"types {off}"
    if not want:
        return "no rows on either side"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return None
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from alertflow.session import get_session

    sf_dir = next((a for a in argv if "/" in a), "/root/testdata/sf0.01")
    names = [a for a in argv if "/" not in a and not a.startswith("+")]
    modules = [a[1:] for a in argv if a.startswith("+")]
    spark = get_session("oracle", os.environ.get("ORACLE_MASTER", "local[8]"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for m in modules:
        names += list(importlib.import_module(f"alertflow.plans.{m}").plans.queries)
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracle:
                note = check(spark, con, sf_dir, queries[name], oracle[name])
            else:
                note = None if queries[name](spark, sf_dir).collect() else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += note is not None
        mark = "ok  " if note is None else "FAIL"
        print(f"{mark} {name}{'' if name in oracle else ' (rows only)'} {time.time() - began:.1f}s {note or ''}", flush=True)
    print(f"{bad} failing of {len(names or queries)}")


if __name__ == "__main__":
    main(sys.argv[1:])
