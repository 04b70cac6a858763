"""Spark-vs-DuckDB result comparison used by the tests (row count, column
names, order-insensitive value hash with doubles rounded)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x, digits) for x in v]
    if isinstance(v, dict):
        return {str(k): _norm(x, digits) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return v


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr([_norm(r[i]) for i in order]) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), [columns[i] for i in order], h


def spark_rows(df):
    def conv(v):
        if hasattr(v, "asDict"):
            return {k: conv(x) for k, x in v.asDict().items()}
        if isinstance(v, list):
            return [conv(x) for x in v]
        return v
    return [tuple(conv(v) for v in r) for r in df.collect()]


def compare(df, con, sql: str):
    """Return (ok, detail) for a Spark DataFrame against DuckDB SQL."""
    s_cols = df.columns
    s = digest(s_cols, spark_rows(df))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    d_rows = [tuple(dict(v) if hasattr(v, "keys") else v for v in r) for r in d_rows]
    d = digest(d_cols, d_rows)
    ok = s == d
    return ok, {"spark": s[:2], "duckdb": d[:2], "hash_equal": s[2] == d[2]}


def _close(a, b, tol: float = 1e-9) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_close(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k], tol) for k in a)
    return a == b


def compare_close(df, con, sql: str, tol: float = 1e-9):
    """Like :func:`compare` but doubles are equal within ``tol`` (summation
    order differs between engines and core counts)."""
    cols = df.columns
    s_rows = [[_norm(v, 12) for v in r] for r in spark_rows(df)]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    if sorted(cols) != sorted(d_cols):
        return False, {"columns": (cols, d_cols)}
    idx = [d_cols.index(c) for c in cols]
    d_rows = [[_norm(dict(r[i]) if hasattr(r[i], "keys") else r[i], 12) for i in idx] for r in res.fetchall()]
    if len(s_rows) != len(d_rows):
        return False, {"rows": (len(s_rows), len(d_rows))}
    key = lambda r: repr([_norm(v, 4) if isinstance(v, (float, list)) else v for v in r])
    s_rows.sort(key=key)
    d_rows.sort(key=key)
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if not _close(a, b, tol)]
    return not bad, {"rows": len(s_rows), "mismatches": bad[:3]}
