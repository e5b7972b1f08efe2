"""Spark-vs-DuckDB comparison of registered queries (test helper and script).

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DUCK_TO_SPARK = {
    "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double", "HUGEINT": "hugeint",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return ("d", str(v.normalize()) if v == v else "nan")
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("t", v.isoformat())
    return ("v", v)


def _duck_type(t: str) -> str:
    t = str(t)
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return DUCK_TO_SPARK.get(t, t.lower())


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    out = {"name": name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.sql(sql)
    o_cols, o_types = rel.columns, [_duck_type(x) for x in rel.types]
    o_rows = rel.fetchall()
    out["oracle_rows"] = len(o_rows)
    s_cols = df.columns
    s_types = [f.dataType.simpleString() for f in df.schema.fields]
    if sorted(s_cols) != sorted(o_cols):
        out["status"] = f"COLUMNS spark={s_cols} oracle={o_cols}"
        return out
    s_order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    o_order = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    type_diff = [(s_cols[i], s_types[i], o_types[j]) for i, j in zip(s_order, o_order) if s_types[i] != o_types[j]]
    sc = collections.Counter(tuple(_norm(r[i]) for i in s_order) for r in rows)
    oc = collections.Counter(tuple(_norm(r[j]) for j in o_order) for r in o_rows)
    if sc != oc:
        extra = list((sc - oc).elements())[:3]
        missing = list((oc - sc).elements())[:3]
        out["status"] = f"VALUES spark-only={extra} oracle-only={missing}"
    else:
        out["status"] = "match" if not type_diff else f"match-values TYPES {type_diff}"
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from larder.session import build_session
    from __spark_entry__ import queries
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names or list(queries()):
        try:
            r = compare(spark, sf_dir, name, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
