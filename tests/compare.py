"""Run a query and its SQL twin and compare names, counts and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


# how the two engines name the same column types
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cur.description}
    mixed = {c: (t, kinds[c]) for c, t in df.dtypes if SAME_TYPE.get(t, t) != kinds[c]}
    if mixed:
        return f"types {mixed}"
    order = [names.index(c) for c in sorted(names)]
    right = Counter(tuple(_cell(r[i]) for i in order) for r in theirs)
    left = Counter(tuple(_cell(r[c]) for c in sorted(names)) for r in df.collect())
    if left != right:
        return (f"{sum(left.values())} vs {sum(right.values())} rows; "
                f"only here {list((left - right).items())[:3]}; only there {list((right - left).items())[:3]}")
    return None
