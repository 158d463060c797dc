"""Compare a Spark query with its DuckDB oracle SQL (test and dev helper).

Mirrors the driver's check: same column names (sorted), same row count and
the same multiset of rows, doubles rounded to 6 digits.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(spark_df, con, sql: str, max_diff: int = 5) -> dict:
    cols = sorted(spark_df.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.select(*cols).collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    out = {"spark_cols": cols, "oracle_cols": sorted(dcols), "spark_rows": len(srows),
           "oracle_rows": len(drows_raw)}
    if sorted(dcols) != cols:
        out["ok"] = False
        out["why"] = "columns differ"
        return out
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    s_sorted, d_sorted = sorted(srows, key=_key), sorted(drows, key=_key)
    diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    out["ok"] = len(srows) == len(drows) and not diffs
    if diffs:
        out["first_diffs"] = diffs[:max_diff]
    return out
