"""Local stand-in for the driver's correctness gate.

Runs every registered Spark query and its DuckDB oracle on the same parquet
folder and compares row count, column names and an order-insensitive hash of
the values.  Usage: ``python tools/oracle_check.py [--sf DIR] [key ...]``.
"""
from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from choicekit.session import local_session  # noqa: E402
from choicekit.sources.tables import TABLES  # noqa: E402
from choicekit.plans.registry import oracle_sql, queries  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return tuple((k, norm(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
                   "smallint": "SMALLINT", "date": "DATE"}


def type_mismatches(scols, stypes, ocols, otypes):
    ot = dict(zip(ocols, otypes))
    return {c: (t, ot.get(c)) for c, t in zip(scols, stypes)
            if SPARK_TO_DUCKDB.get(t, t) != ot.get(c)}


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16], keyed


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    qs, sqls = queries(), oracle_sql()
    keys = a.keys or list(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, a.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            stypes = [f.dataType.simpleString() for f in df.schema.fields]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[k])
            orows = cur.fetchall()
            ocols = [d[0] for d in cur.description]
            otypes = [str(d[1]) for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ks = digest(scols, srows)
        ho, ko = digest(ocols, orows)
        ok = len(srows) == len(orows) and sorted(scols) == sorted(ocols) and hs == ho
        tag = "OK  " if ok else "FAIL"
        print(f"{tag} {k}: rows {len(srows)}/{len(orows)} hash {hs}/{ho} {ts:.1f}s")
        if not ok:
            bad += 1
            if sorted(scols) != sorted(ocols):
                print("   cols", sorted(scols), sorted(ocols))
            diff_s = [x for x in ks if x not in set(ko)][:3]
            diff_o = [x for x in ko if x not in set(ks)][:3]
            print("   spark-only", [d[:300] for d in diff_s])
            print("   oracle-only", [d[:300] for d in diff_o])
        tm = type_mismatches(scols, stypes, ocols, otypes)
        if tm:
            print(f"   type differences {k}: {tm}")
        if not ok or os.environ.get("SHOW_TYPES"):
            st = dict(zip(scols, stypes))
            ot = dict(zip(ocols, otypes))
            print("   types", {c: (st.get(c), ot.get(c)) for c in sorted(set(scols) | set(ocols))})
    print(f"{len(keys) - bad}/{len(keys)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
