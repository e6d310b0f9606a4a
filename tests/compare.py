"""Runs a query on Spark and its SQL on DuckDB and compares names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", repr(v + 0.0))
    if isinstance(v, decimal.Decimal):
        return ("f", repr(float(v)))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


_SPARK_TYPES = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Human-readable differences; empty when both sides agree exactly."""
    out = []
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns: {sorted(set(names) ^ set(rel.columns))}"]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        want = _SPARK_TYPES.get(f.dataType.typeName(), f.dataType.typeName())
        if types[f.name] != want:
            out.append(f"type {f.name}: spark {want}, duckdb {types[f.name]}")
    position = [rel.columns.index(n) for n in names]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=key)
    want = sorted((tuple(_value(r[i]) for i in position) for r in rel.fetchall()), key=key)
    if len(got) != len(want):
        out.append(f"rows: spark {len(got)}, duckdb {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} of {len(want)} rows differ")
        for g, w in bad[:limit]:
            out.append(str({n: (a, b) for n, a, b in zip(names, g, w) if a != b}))
    return out
