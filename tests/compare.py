"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 8) + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def differences(df, sql: str, sf_dir: str) -> list[str]:
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want, want_names = rows_of(*oracle(sql, sf_dir))
    out = [] if got_names == want_names else [f"columns {got_names} and {want_names}"]
    if len(got) != len(want):
        out.append(f"{len(got)} and {len(want)} rows")
    out += [f"{a} and {b}" for a, b in zip(got, want, strict=False) if a != b][:3]
    return out
