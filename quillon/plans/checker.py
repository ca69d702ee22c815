"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os

from quillon.sources.tables import TABLES, table_path


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits) + 0.0
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, sql: str, con, digits: int = 5) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols),
           "spark_cols": s_cols, "oracle_cols": d_cols}
    if not res["cols_match"] or len(s_rows) != len(d_rows):
        res["values_match"] = False
        return res
    a, b = _rows(s_cols, s_rows, digits), _rows(d_cols, d_rows, digits)
    mism = [(x, y) for x, y in zip(a, b) if x != y]
    res["values_match"] = not mism
    res["first_mismatch"] = mism[:3]
    return res
