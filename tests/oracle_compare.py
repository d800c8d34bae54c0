"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive value hash.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        r = round(v, 6)
        if r == 0:
            r = 0.0
        return repr(float(r))
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def frame_hash(pdf: pd.DataFrame) -> tuple[int, list[str], str, list[str]]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h, rows


def _to_py(pdf):
    return pdf.astype(object).where(pdf.notna(), None)


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spdf = pd.DataFrame([r.asDict(recursive=True) for r in sdf.collect()], columns=sdf.columns)
            t1 = time.time()
            if name not in sqls:
                results[name] = ("rows-only", len(spdf))
                if verbose:
                    print(f"{name:32s} rows-only rows={len(spdf)} spark={t1 - t0:.1f}s")
                continue
            dpdf = con.execute(sqls[name]).df()
            n1, c1, h1, r1 = frame_hash(_to_py(spdf))
            n2, c2, h2, r2 = frame_hash(_to_py(dpdf))
            ok = (n1, c1, h1) == (n2, c2, h2)
            results[name] = ok
            if verbose:
                print(f"{name:32s} {'OK ' if ok else 'BAD'} rows={n1}/{n2} spark={t1 - t0:.1f}s")
                if not ok:
                    if c1 != c2:
                        print("   cols spark-only:", sorted(set(c1) - set(c2)), "duck-only:", sorted(set(c2) - set(c1)))
                    else:
                        s1, s2 = set(r1), set(r2)
                        print("   spark-only sample:", list(s1 - s2)[:2])
                        print("   duck-only  sample:", list(s2 - s1)[:2])
        except Exception as exc:  # noqa: BLE001
            results[name] = f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
            if verbose:
                print(f"{name:32s} ERROR {type(exc).__name__}: {str(exc)[:600]}")
    return results


if __name__ == "__main__":
    from echoline.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v is not True and not (isinstance(v, tuple))]
    print("FAILED:", bad)
