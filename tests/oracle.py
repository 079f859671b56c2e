"""Comparison of a Spark result with its SQL twin, as multisets of normalised rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return ("float", round(value, 6) if math.isfinite(value) else str(value))
    if isinstance(value, (bytes, bytearray)):
        return ("bytes", bytes(value).hex())
    return (type(value).__name__, str(value))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(normal(row[c]) for c in columns) for row in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(normal(row[i]) for i in at) for row in result.fetchall())
