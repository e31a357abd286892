"""Compare every registered query with its DuckDB oracle SQL.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]

Rows are compared order-insensitively after sorting columns by name; floats
are compared exactly first and then with a relative tolerance so a near miss
is reported as such.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v, approx=False):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if approx:
            return f"{v:.9g}"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() or True else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, approx) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x, approx)}" for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))) + "}"
    if hasattr(v, "asDict"):
        return _norm(tuple(v), approx)
    return str(v)


def _rows(cols, rows, approx):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i], approx) for i in order) for r in rows)


# Spark simple type -> DuckDB type name, for the schema check.
TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB", "float": "FLOAT",
            "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}


def type_mismatches(spark_schema, duck_columns, duck_types):
    got = dict(zip(duck_columns, [str(t).replace(" ", "") for t in duck_types]))
    bad = []
    for f in spark_schema.fields:
        t = f.dataType.simpleString()
        want = TYPE_MAP.get(t, t.upper()).replace(" ", "")
        if got.get(f.name) != want:
            bad.append((f.name, t, got.get(f.name)))
    return bad


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, sf_dir, con):
    from gaugeworks.plans.registry import ORACLE, QUERIES
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if name not in ORACLE:
        return {"name": name, "status": "rows-only", "rows": len(srows), "sec": round(t1 - t0, 2)}
    res = con.sql(ORACLE[name])
    dcols = res.columns
    drows = res.fetchall()
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "sec": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS spark={scols} oracle={dcols}"
        return out
    if len(srows) != len(drows):
        out["status"] = "ROWCOUNT"
        return out
    if _rows(scols, srows, False) == _rows(dcols, drows, False):
        bad = type_mismatches(sdf.schema, dcols, res.types)
        out["status"] = "ok" if not bad else f"TYPES {bad}"
    elif _rows(scols, srows, True) == _rows(dcols, drows, True):
        out["status"] = "APPROX"
    else:
        a, b = _rows(scols, srows, True), _rows(dcols, drows, True)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out["status"] = f"VALUES {sorted(scols)} first diffs: {diff}"
    return out


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from gaugeworks.plans.registry import QUERIES, load_all
    from gaugeworks.session import build_session
    load_all()
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    names = args.names or sorted(QUERIES)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, args.sf, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
