"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same parquet files and compare row count,
column names and an order-insensitive digest of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        return round(f, 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("set TimeZone='UTC'")
    return con


def _family(t: str) -> str:
    t = t.lower()
    for fam, keys in [("int", ["bigint", "long", "int", "hugeint", "smallint", "tinyint"]),
                      ("float", ["double", "float", "decimal"]), ("bool", ["bool"]),
                      ("ts", ["timestamp"]), ("date", ["date"]), ("str", ["string", "varchar"]),
                      ("list", ["array", "[]"])]:
        if any(k in t for k in keys):
            return fam + (":" + t if fam == "int" else "")
    return t


def _spark_int_width(t: str) -> str:
    return {"bigint": "int:bigint", "int": "int:integer", "smallint": "int:smallint", "tinyint": "int:tinyint"}.get(t, t)


def compare(spark, fn, sql: str | None, sf_dir: str, con=None):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    if sql is None:
        return {"ok": None, "rows": len(s_rows)}
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    sc, sr = _canon(s_cols, s_rows)
    dc, dr = _canon(d_cols, d_rows)
    res = {"rows_spark": len(sr), "rows_duck": len(dr), "cols_spark": sc, "cols_duck": dc}
    res["ok"] = (sc == dc and sr == dr)
    tmis = {}
    for c in s_cols:
        if c in d_types:
            a = _family(s_types[c])
            a = _spark_int_width(s_types[c]) if a.startswith("int") else a
            b = _family(d_types[c])
            if a != b:
                tmis[c] = (s_types[c], d_types[c])
    if tmis:
        res["type_mismatch"] = tmis
    if not res["ok"] and sc == dc:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["only_spark"] = diff_s
        res["only_duck"] = diff_d
    return res
