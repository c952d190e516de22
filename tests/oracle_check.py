"""Run every registered query in Spark and its DuckDB twin, compare like the driver does.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from solera.mapping import DRIVER_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def spark_type(dt_) -> str:
    s = dt_.simpleString()
    return {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
            "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
            "timestamp": "TIMESTAMP WITH TIME ZONE", "array<string>": "VARCHAR[]"}.get(s, s.upper())


def duck_type(t) -> str:
    return str(t).upper()


def duck(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in sorted(qs):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"rows-only {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            rel = con.sql(oracle[name])
            dtypes = {c: duck_type(t) for c, t in zip(rel.columns, rel.types)}
            cur = con.execute(oracle[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        a, ac = rows_of(scols, srows)
        b, bc = rows_of(dcols, drows)
        if ac != bc:
            bad.append(name)
            print(f"FAIL {name}: columns spark={ac} duck={bc}")
        elif a != b:
            bad.append(name)
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}\n  spark-only {diff_a}\n  duck-only {diff_b}")
        else:
            stypes = {f.name: spark_type(f.dataType) for f in df.schema.fields}
            tdiff = {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)}
            if tdiff:
                print(f"TYPE {name}: {tdiff}")
            if verbose:
                print(f"ok   {name}: {len(a)} rows ({ts:.1f}s)")
    return bad


if __name__ == "__main__":
    from solera.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    bad = check(spark, sf, set(sys.argv[2:]) or None)
    print("BAD:", bad)
    sys.exit(1 if bad else 0)
