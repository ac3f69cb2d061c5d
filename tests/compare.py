"""Run a query and its SQL on the same files and report the first difference."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if hasattr(v, "isoformat"):
        return (1, pd.Timestamp(v).isoformat())
    if isinstance(v, float):
        return (1, f"{v + 0.0:.9g}")
    return (1, str(v))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def difference(df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    want_kinds = dict(zip(rel.columns, [KINDS.get(str(t), str(t)) for t in rel.types]))
    got_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if set(want_kinds) != set(got_kinds):
        return f"columns {sorted(got_kinds)} instead of {sorted(want_kinds)}"
    odd = {c: (got_kinds[c], want_kinds[c]) for c in got_kinds if got_kinds[c] != want_kinds[c]}
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(rel.columns, rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {sorted(df.columns)}\n   got {bad[0][0]}\n  want {bad[0][1]}"
    return f"types {odd}" if odd else None
