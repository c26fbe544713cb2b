"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype("int64")
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def digest(df: pd.DataFrame) -> str:
    return hashlib.sha1(df.map(repr).to_csv(index=False).encode()).hexdigest()


def close(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    if a.shape != b.shape:
        return False
    for c in a.columns:
        x, y = a[c], b[c]
        try:
            xf, yf = x.astype(float), y.astype(float)
            if not np.allclose(xf, yf, rtol=1e-7, atol=1e-9, equal_nan=True):
                return False
        except (TypeError, ValueError):
            if not (x.map(repr) == y.map(repr)).all():
                return False
    return True


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as se
    from tidemark.session import get_session

    spark = get_session("local[8]", 8)
    qs, sql = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s = sdf.toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(exc).splitlines()[0][:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"{name:28s} rows={len(s):7d} spark={t1 - t0:5.1f}s (no oracle)")
            continue
        try:
            d = con.execute(sql[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(exc).splitlines()[0][:300]}")
            bad += 1
            continue
        t2 = time.time()
        if sorted(s.columns) != sorted(d.columns):
            print(f"{name:28s} COLUMNS spark={sorted(s.columns)} duck={sorted(d.columns)}")
            bad += 1
            continue
        cs, cd = canon(s), canon(d)
        exact = len(cs) == len(cd) and digest(cs) == digest(cd)
        ok = exact or close(cs, cd)
        bad += 0 if exact else 1
        print(f"{name:28s} rows={len(s):7d}/{len(d):7d} {'EXACT' if exact else ('CLOSE' if ok else 'DIFF')} "
              f"spark={t1 - t0:5.1f}s duck={t2 - t1:5.1f}s")
        if not exact and os.environ.get("SHOW"):
            print(cs.head(5).to_string()); print(cd.head(5).to_string())
            print(s.dtypes.to_dict()); print(d.dtypes.to_dict())
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv)
