"""Compare registered queries with their SQL twins, value by value.

    python tests/oracle_check.py [sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ("part", "orders"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, missing values as None, whole numbers alike, rows in order."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    keys = [df[c].astype(str) for c in df.columns]
    order = pd.concat(keys, axis=1).agg("|".join, axis=1).argsort(kind="stable") if len(df) else []
    return df.iloc[order].reset_index(drop=True)


def mismatch(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} / {len(duck_df)}"
    a, b = tidy(spark_df), tidy(duck_df)
    for c in a.columns:
        left, right = a[c], b[c]
        same = (left == right) | (left.isna() & right.isna())
        if not same.all():
            at = same[~same].index[0]
            return f"column {c}: {int((~same).sum())} of {len(a)} differ, first\n{a.loc[at].to_dict()}\n{b.loc[at].to_dict()}"
    return None


def main() -> int:
    from catalog.oracle import ORACLE
    from catalog.queries import QUERIES
    from mapweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    sf_dir = f"{TESTDATA}/{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            start = time.time()
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            said = "no twin" if name not in ORACLE else mismatch(got, con.execute(ORACLE[name]).df()) or "ok"
            print(f"CHECK {name} rows={len(got)} spark={took:.1f}s duck={time.time() - start:.1f}s {said}", flush=True)
            bad += said not in ("ok", "no twin")
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"CHECK {name} ERROR {str(error)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
