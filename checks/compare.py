"""Run registered queries against DuckDB on the same parquet tables.

Usage: python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
            return ""
        return repr(x.item() if hasattr(x, "item") else x)
    cols = sorted(df.columns)
    return sorted(tuple(value(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def check(spark: SparkSession, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(got)} rows {took:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    duck = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    a, b = rows(got), rows(want)
    if a == b:
        note = f" DTYPES {kinds}" if kinds and len(got) else ""
        return not note, f"{len(a)} rows spark {took:.1f}s duckdb {duck:.1f}s{note}"
    left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    cols = sorted(got.columns)
    diff = ""
    if left and right:
        diff = str([(c, x, y) for c, x, y in zip(cols, left[0], right[0]) if x != y][:6])
    return False, f"{len(a)} vs {len(b)} rows, differ {len(set(a) - set(b))}; {kinds} {diff}\n   spark {left[:1]}\n   duck  {right[:1]}"


def main(argv: list[str]) -> int:
    from checks.catalog import ORACLES, QUERIES
    from netloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session("8", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in [n for n in QUERIES if n in names or any(n.startswith(p[:-1]) for p in names if p.endswith("*"))]:
        try:
            ok, note = check(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
