"""Run the registered queries next to their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if type(a) is not type(b):
        return False
    return math.isclose(a, b, rel_tol=0, abs_tol=1e-9) if isinstance(a, float) else a == b


def compare(spark, con, name, build, sql, sf_dir) -> tuple[str | None, int, float, float]:
    """Difference found (None if equal), rows, seconds in Spark, seconds in DuckDB."""
    start = time.time()
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*columns).collect()]
    spark_seconds = time.time() - start
    if sql is None:
        return None, len(ours), spark_seconds, 0.0
    start = time.time()
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    sql_seconds = time.time() - start
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}", len(ours), spark_seconds, sql_seconds
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in theirs]
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows", len(ours), spark_seconds, sql_seconds
    for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key)):
        if not all(map(_same, a, b)):
            return f"{a} and {b}", len(ours), spark_seconds, sql_seconds
    return None, len(ours), spark_seconds, sql_seconds
