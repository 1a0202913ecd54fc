"""Comparison of a result with SQL run by DuckDB over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return None if v is None else str(v)


def differs(df, sql: str, folder: str) -> str | None:
    """What differs, or None."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    take = lambda rows, cols: sorted((tuple(_plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=str)
    a, b = take(df.collect(), df.columns), take(cur.fetchall(), names)
    return None if a == b else f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b), key=str)[:2]}, only there {sorted(set(b) - set(a), key=str)[:2]}"
