"""Runs a registered query and its SQL twin and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 6)) if not isinstance(v, list | dict) else (False, "", str(v)) for v in r))


def differences(got, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's rows; empty if they agree."""
    mine = [tuple(r) for r in got.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(got.columns) != sorted(names):
        return [f"columns {sorted(got.columns)} and {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"]
    out = []
    for a, b in zip(_sorted(got.columns, mine), _sorted(names, theirs), strict=True):
        for c, x, y in zip(sorted(names), a, b, strict=True):
            same = x == y if not (isinstance(x, float) or isinstance(y, float)) or x is None or y is None else math.isclose(x, float(y), rel_tol=1e-9, abs_tol=1e-12) and type(x) is type(y)
            if not same:
                out.append(f"{c}: {x!r} and {y!r}")
    return out[:5]
