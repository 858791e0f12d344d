"""Runs a query's SQL in DuckDB over Parquet tables and compares values with Spark's rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def compare(df, sql: str, sf_dir: str) -> None:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    rows = [tuple(x) for x in r.fetchall()]
    assert sorted(df.columns) == sorted(names)
    mine = [tuple(x[n] for n in sorted(names)) for x in df.collect()]
    at = [names.index(n) for n in sorted(names)]
    theirs = [tuple(x[i] for i in at) for x in rows]
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs))
