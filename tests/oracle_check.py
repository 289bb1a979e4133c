"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from hireframe.session import build_session  # noqa: E402
from hireframe.sources.fixtures import TABLES  # noqa: E402
import __spark_entry__ as E  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    rows = [tuple((0, "") if x is None else (1, repr(x)) for x in r) for r in rows]
    return cols, sorted(rows)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, sf_dir, name, verbose=True):
    q = E.queries()[name]
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return name, "rows-only", len(sdf), None, t1 - t0
    odf = con.execute(sql).fetchdf()
    sc, sr = canon(sdf)
    oc, orows = canon(odf)
    ok = sc == oc and sr == orows
    msg = "OK" if ok else "MISMATCH"
    if not ok and verbose:
        print(name, "spark cols", sc, "oracle cols", oc, "rows", len(sr), len(orows))
        a, b = set(sr), set(orows)
        print("  only spark:", list(a - b)[:3])
        print("  only oracle:", list(b - a)[:3])
    return name, msg, len(sdf), len(odf), t1 - t0


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = check(spark, con, sf_dir, n)
        except Exception as e:  # report and continue
            r = (n, "ERROR " + repr(e)[:400], None, None, 0)
        print(*r, flush=True)
        bad += r[1] not in ("OK", "rows-only")
    print("failures:", bad)


if __name__ == "__main__":
    main()
