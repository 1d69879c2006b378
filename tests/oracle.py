"""Side-by-side check of a registered query against its DuckDB oracle:
row count, column names and an order-insensitive hash of rounded values."""

from __future__ import annotations

import hashlib
import math

import duckdb

from kiln.plans.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=9):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, digits) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return str(v)


def digest(cols, rows, digits=9):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i], digits) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def compare(spark_df, con, sql, digits=9):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"rows_spark": len(s_rows), "rows_oracle": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    hs, ls = digest(s_cols, s_rows, digits)
    hd, ld = digest(d_cols, d_rows, digits)
    out["hash_match"] = hs == hd
    if not out["hash_match"]:
        diff_s = sorted(set(ls) - set(ld))[:3]
        diff_d = sorted(set(ld) - set(ls))[:3]
        out["spark_only"] = diff_s
        out["oracle_only"] = diff_d
        out["cols"] = (sorted(s_cols), sorted(d_cols))
    return out
