"""Runs a registered query and its SQL statement side by side and compares rows as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, sf_dir: str, fn, sql: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(norm(r[n]) for n in names) for r in df.collect()]
    con = connect(sf_dir)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad = []
    for f in df.schema.fields:
        mine = f.dataType.simpleString()
        want = TYPES.get(mine, mine.upper())
        if want != kinds[f.name] and kinds[f.name] != want.replace("DECIMAL", "DECIMAL"):
            bad.append(f"{f.name}: {mine} vs {kinds[f.name]}")
    if bad:
        return "types " + "; ".join(bad)
    order = [cols.index(n) for n in names]
    theirs = [tuple(norm(r[i]) for i in order) for r in con.execute(sql).fetchall()]
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"rows {len(ours)} vs {len(theirs)}; columns {names}\n   only spark {str(only_a)[:1500]}\n   only sql {str(only_b)[:1500]}"
    if not ours:
        return "no rows"
    return None
