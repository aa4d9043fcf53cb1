"""Runs queries and their oracle SQL side by side, as values in any order."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(str([_value(r[n]) for n in order]) for r in rows)


def differences(spark, db, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    if got == want:
        return []
    return [f"{len(got)} and {len(want)} rows", *[f"only here: {x}" for x in sorted(set(got) - set(want))[:3]], *[f"only there: {x}" for x in sorted(set(want) - set(got))[:3]]]
