"""Spark-vs-DuckDB comparison in the shape of the driver's correctness check:
row count, column names, and an order-insensitive multiset of row values."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TEST_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
EXACT = {"on": False}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT["on"] else round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql: str, check_types: bool = False, exact: bool = False):
    """Return (ok, message). ``check_types`` also compares column types;
    ``exact`` compares doubles bit for bit instead of at 9 decimals."""
    EXACT["on"] = exact
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    if check_types:
        rel = con.sql(sql)
        d_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
        for f in spark_df.schema.fields:
            st = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
            if d_types.get(f.name) != st:
                return False, f"type of {f.name}: spark={st} duck={d_types.get(f.name)}"
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(1 for x, y in zip(a, b) if x != y)} rows), e.g. {diffs}"
    return True, f"{len(s_rows)} rows"
