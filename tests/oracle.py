"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences (empty if equal)."""
    got_rows = [tuple(r) for r in df.collect()]
    result = con.sql(sql)
    want_columns = result.columns
    if sorted(df.columns) != sorted(want_columns):
        return len(got_rows), [f"columns {sorted(df.columns)} != {sorted(want_columns)}"]
    want_types = {c: TYPES.get(str(t)) for c, t in zip(want_columns, result.types, strict=True)}
    if dict(df.dtypes) != want_types:
        return len(got_rows), [f"types {sorted(set(df.dtypes) ^ set(want_types.items()))}"]
    got = _rows(df.columns, got_rows)
    want = _rows(want_columns, result.fetchall())
    if len(got) != len(want):
        return len(got), [f"{len(got)} rows, SQL gives {len(want)}"]
    return len(got), [f"{g} != {w}" for g, w in zip(got, want, strict=True) if repr(g) != repr(w)][:5]
